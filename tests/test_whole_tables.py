"""Queries over whole tables against brute force: parts and orders of any id take part."""

import datetime
import random

import pytest

from recordlake.plans import catalog

NAMES = ["red bolt", "blue nut", "green gear", "tin cog"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    at = str(tmp_path_factory.mktemp("whole"))
    parts = [(k, r.choice(NAMES), f"Brand#{r.randint(1, 29)}") for k in [*range(40), *range(650, 900)]]
    orders = [(k, k, "O", 1.0, datetime.date(r.randint(1992, 2003), r.randint(1, 12), 15), "5-LOW") for k in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    return at, parts, [(k, str(d)) for k, _, _, _, d, _ in orders]


def schedule_row(code, filed, parts):
    """(title, effective_from, source, tier) of the best schedule row, or None."""
    rows = []
    for k, name, brand in parts:
        if brand != code:
            continue
        title, start, end = name + (": SECOND DEGREE" if k % 3 == 0 else ""), f"{1994 + k % 8}-01-01", f"{1994 + k % 8}-12-31" if k % 2 == 0 else "9999"
        priority, general, source = {0: 3, 1: 2}.get(k % 5, 1), 0 if k % 3 == 0 else 3, f"src{k:09d}"
        tier = 6 if filed == "" else (0 if filed <= end else 2) if start <= filed else 4
        tier += tier < 6 and priority < 3
        date = int(start.replace("-", ""))
        rows.append((tier, -priority, -general, date if tier in (4, 5) else -date, len(title), source, title, start))
    return (lambda x: (x[6], x[7], x[5], x[0]))(min(rows)) if rows else None


def test_schedule_asof_whole(spark, tables):
    at, parts, orders = tables
    want = {}
    for k, filed in orders:
        x = schedule_row(f"Brand#{k % 30}", "" if k % 11 == 0 else filed, parts)
        if x:
            want[k] = x[:3]
    rows = catalog.QUERIES["schedule_asof"](spark, at).collect()
    assert len(rows) == len(want) and {r["id"]: (r["title"], r["effective_from"], r["source"]) for r in rows} == want
    assert any(k % 3 for k in want) and any(int(x[2][3:]) >= 700 for x in want.values())


def test_schedule_fallback_key_whole(spark, tables):
    at, parts, orders = tables
    want = {}
    for k, filed in orders:
        x = schedule_row(f"Brand#{k % 30}", filed, parts) if k % 2 == 0 else None
        x = x or schedule_row(f"Brand#{k % 7 + 1}", filed, parts)
        if x:
            want[k] = (x[0], x[2])
    rows = catalog.QUERIES["schedule_fallback_key"](spark, at).collect()
    assert len(rows) == len(want) and {r["id"]: (r["title"], r["source"]) for r in rows} == want


def test_version_asof_whole(spark, tables):
    at, parts, orders = tables
    want = {}
    for k, filed in orders:
        code, filed = f"Brand#{k % 30}", "" if k % 11 == 0 else filed
        own = sorted(p for p, _, b in parts if b == code)
        hit = [p for p in own if filed and f"{1993 + p % 7}-06-01" <= filed and (p % 3 == 0 or filed <= f"{1994 + p % 7}-05-31")]
        start = "1999-01-01" if own and own[0] % 4 > 0 else None
        if hit:
            want[k] = (f"u{hit[0]}", "historical_version_at_filing")
        elif not own:
            want[k] = (None, "no_version")
        elif filed and start and filed < start:
            want[k] = (None, "current_version_postdates_filing")
        else:
            want[k] = (f"c{code}", "current_version_filing_date_unknown" if not filed else "current_version_at_or_before_filing" if start else "current_version_unverified")
    rows = catalog.QUERIES["version_asof"](spark, at).collect()
    assert len(rows) == len(want) and {r["id"]: (r["url"], r["status"]) for r in rows} == want
    assert any(k % 3 and u and u.startswith("u") and int(u[1:]) >= 60 for k, (u, _) in want.items())


def test_spellings_of_all_parts(spark, tmp_path):
    at = str(tmp_path)
    parts = [(1, "red bolt", "A", "TIN", 3), (9000, "red bolt", "B", "TIN", 3), (9001, "blue nut", "B", "TIN", 5), (2, "tin cog", "A", "ZINC", 8), (9002, "tin cog", "A", "ZINC", 4), (9003, "tin cog", "A", "ZINC", 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{at}/part.parquet")
    got = {(r["spelling"], r["owner"]) for r in catalog.QUERIES["alias_unique_join"](spark, at).collect()}
    assert got == {("blue nut tin 5", "B"), ("tin cog zinc 4", "A")}  # red bolt has two owners; tin cog zinc 8 is the route of size 4
    assert {(r["brand"], r["total"]) for r in catalog.QUERIES["tentative_counts"](spark, at).collect()} == {("A", 16), ("B", 5)}
