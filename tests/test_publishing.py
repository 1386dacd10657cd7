"""Builds that end in published sets, and the linear form of merging names."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from recordlake.operators import identity, publishing
from recordlake.sources import sinks


def agrees(a, b):
    return len(a) == len(b) and all(x == y or (1 in (len(x), len(y)) and x[0] == y[0]) for x, y in zip(a, b))


def plain_merge(names):
    full, bare = {}, []
    for n in {x for x in names if x}:
        w = n.split(" ")
        (full.setdefault((w[0], w[-1]), []) if len(w) > 1 else bare).append(n)
    root = {}
    for group in full.values():
        middles = [tuple(n.split(" ")[1:-1]) for n in group if n.count(" ") > 1]
        unite = all(agrees(a, b) for a, b in itertools.product(middles, middles))
        root |= {n: min(group) if unite else n for n in group}
    for n in bare:
        owners = {root[x] for x in root if x.split(" ")[-1] == n and " " in x}
        root[n] = owners.pop() if len(owners) == 1 else n
    best = {}
    for n, r in root.items():
        best[r] = max(best.get(r, (0, 0, "")), (len(n.split(" ")), len(n), n))
    return {n: best[r][2] for n, r in root.items()}


def test_merging_equals_the_pairwise_rule(spark):
    r = random.Random(9)
    for seed in range(6):
        middle = [["a", "al", "ann", "b", "bo", "c"][: r.randint(2, 6)], ["x", "xi", "y"]]
        names = {" ".join([r.choice(["jo", "ed"]), *[r.choice(middle[k % 2]) for k in range(r.choice([0, 1, 1, 2]))], r.choice(["fox", "lee", "kim"])]) for _ in range(r.choice([4, 8, 30]))}
        names |= set(r.sample(["fox", "lee", "kim", "solo", ""], 3))
        got = {x["norm"]: x["target"] for x in identity.merge_names(spark.createDataFrame([(n,) for n in names], "norm string")).collect()}
        assert got == plain_merge(names), names


def test_many_middle_names_of_one_person_are_no_pairs(spark):
    names = spark.range(3000).select(F.concat(F.lit("jo m"), F.col("id").cast("string"), F.lit(" fox")).alias("norm"))
    df = identity.merge_names(names)
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.where("norm = target").count() == 3000


def test_wrong_counts_publish_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("C1", "Civil", "civil", "Unknown", "civil:unknown")], "case_number string, matter_type string, matter_type_key string, matter_category string, matter_category_key string")
    with pytest.raises(ValueError, match="enriched 1 of 2"):
        publishing.publish_matters({"rows": rows, "groups": rows}, f"{tmp_path}/m", 2)
    assert not os.path.exists(f"{tmp_path}/m")
    assert publishing.publish_matters({"rows": rows, "groups": rows}, f"{tmp_path}/m", 1)["rows"] == 1
    bad = spark.createDataFrame([(1, 3, 2, 10.0, 4.0)] * 2, "bar int, judgment_count int, case_count int, total_amount double, largest_amount double")
    with pytest.raises(ValueError, match="repeated"):
        publishing.publish_profiles(bad, "bar", f"{tmp_path}/p")
    assert sinks.current(spark, f"{tmp_path}/p", missing_ok=True) is None


def test_routes_of_lost_and_repeated_records(spark):
    records = spark.createDataFrame([("a", 0, "k1", "One"), ("a", 1, None, "None"), ("b", 0, " ", "Blank"), ("b", 1, "k2", "Two"), ("c", 0, "k1", "One again")], "path string, idx long, id string, display_name string")
    old = spark.createDataFrame([("r1", "a", 0), ("r2", "a", 1), ("r3", "b", 1), ("r3", "a", 0), ("r4", "z", 9)], "route string, path string, idx long")
    t = publishing.route_shards(records, old, "people", "id", 8, 4)
    assert {r["route"]: r["display_name"] for r in t["routes"].collect()} == {"r1": "One", "r3": "One"}
    assert sorted(r["display_name"] for r in t["records"].collect()) == ["One", "One again", "Two"]


def test_drill_down_and_dashboard_of_nulls(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 3), ("b", "x", 4)], "p string, q string, v int")
    got = publishing.drill_down(df, ["p", "q"], {"n": F.count(F.lit(1)), "v": F.sum("v")})
    assert sorted(map(str, got.select("depth", "p", "q", "n", "share").collect())) == sorted(str(r) for r in spark.createDataFrame([
        (0, None, None, 4, 100.0), (1, "a", None, 2, 50.0), (1, None, None, 1, 25.0), (1, "b", None, 1, 25.0), (2, "a", "x", 1, 50.0), (2, "a", None, 1, 50.0), (2, None, "x", 1, 100.0), (2, "b", "x", 1, 100.0),
    ], got.select("depth", "p", "q", "n", "share").schema).collect())
    d = publishing.dashboard(df, ["p", "q"], {"n": F.count(F.lit(1))}).collect()
    assert sorted(map(tuple, d), key=str) == sorted([("p", "a", 2), ("p", "b", 1), ("p", None, 1), ("q", "x", 3), ("q", None, 1)], key=str)
