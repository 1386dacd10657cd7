"""Stored forms: what is read, what is decoded, what readers see; and the as-of look-ups at size."""

import bisect
import os
import random

import pytest
from pyspark.sql import functions as F

from recordlake.operators import asof, bands, bitmaps, caseparts, charges, intervals, postings, routes, search, sketches, udtfs
from recordlake.operators.captions import pretty
from recordlake.functions import hashing, text
from recordlake.sources import sinks, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(df):
    return {os.path.relpath(r[0]) for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "9000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('dir')}/table"
    rows = [(f"C{i:04d}", f"case {i}", ["CGC", "CRI", "PES"][i % 3], 1990 + i % 10) for i in range(600)]
    df = spark.createDataFrame(rows, "case_number string, case_title string, prefix string, year int")
    tables.write_directory(df, at)
    return at, rows


def test_static_pruning(spark, directory):
    at, rows = directory
    q = search.parse_query("case-title:7 from:1993 to:1994")
    df = search.directory(tables.read_directory(spark, at), q, prefixes=["CRI"])
    plan = plan_of(df)
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "prefix" in filters and "year" in filters and "case_title" not in filters
    assert sorted(r["case_number"] for r in df.collect()) == sorted(n for n, t, p, y in rows if p == "CRI" and y in (1993, 1994) and "7" in t)
    assert all("prefix=CRI/year=199" in f for f in files_of(df)) and len(files_of(df)) <= 2


def test_dynamic_pruning(spark, directory):
    at, rows = directory
    refs = spark.createDataFrame([(n, p, y) for n, _, p, y in rows[:40]], "case_number string, prefix string, year int").where("year = 1995 and case_number like 'C00%'")
    df = tables.read_directory(spark, at).join(F.broadcast(refs), ["prefix", "year", "case_number"])
    assert "dynamicpruning" in plan_of(df).lower()
    got = tables.records_of(refs, tables.read_directory(spark, at))
    assert sorted(r["case_number"] for r in got.collect()) == sorted(n for n, _, p, y in rows[:40] if y == 1995)


def test_a_page_touches_one_file(spark, tmp_path):
    df = spark.range(1, 2001).withColumnRenamed("id", "ordinal").withColumn("v", F.col("ordinal") * 7).repartition(5)
    tables.write_pages(df, "ordinal", f"{tmp_path}/p", 500)
    for after, size, files in ((0, 50, 1), (480, 50, 2), (1000, 500, 1), (1990, 50, 1), (2000, 50, 0)):
        page = tables.page(spark, f"{tmp_path}/p", "ordinal", after, size, 500)
        assert "shard" in (p := plan_of(page))[p.index("PartitionFilters") :].split("]")[0]
        assert sorted(r["ordinal"] for r in page.collect()) == [i for i in range(after + 1, after + size + 1) if i <= 2000]
        assert len(files_of(page)) == files


def test_readers_see_one_build(spark, tmp_path):
    at = f"{tmp_path}/set"

    def build(n):
        f = spark.createDataFrame([(f"l{i}", n, f"k{i}") for i in range(n)], "label string, case_count int, facet_key string")
        return sinks.facet_tables(f.select("label", "case_count"), f.select("facet_key", "label"), f.select("facet_key", F.lit(1).alias("c")), at)

    assert build(3) == {"list": 3, "search": 3, "cases": 3}
    old = {n: sinks.current(spark, f"{at}/{n}") for n in ("list", "search", "cases")}
    assert len({os.path.dirname(p) for p in old.values()}) == 1
    assert sinks.set_faults(spark, at).count() == 0
    build(5)
    new = {n: sinks.current(spark, f"{at}/{n}") for n in ("list", "search", "cases")}
    assert len({os.path.dirname(p) for p in new.values()}) == 1 and set(old.values()).isdisjoint(new.values())
    assert spark.read.json(old["list"]).count() == spark.read.parquet(old["search"]).count() == 3  # a reader that began before goes on
    assert sinks.table_rows(spark, at) == {"list": 5, "search": 5, "cases": 5}
    # a build that fails leaves the current one
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.publish_set(spark, at, {"list": (spark.range(2), lambda df, p: df.write.json(p)), "search": (bad, lambda df, p: df.write.parquet(p))})
    assert {n: sinks.current(spark, f"{at}/{n}") for n in new} == new
    name = next(f for f in os.listdir(new["search"]) if f.endswith(".parquet"))
    os.remove(f"{new['search']}/.{name}.crc")
    with open(f"{new['search']}/{name}", "ab") as f:
        f.write(b"x")
    assert [r["fault"] for r in sinks.set_faults(spark, at).orderBy("fault").collect()] == ["missing or changed", "not announced"]


def test_look_up_errors_are_told_from_damage(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, i int")
    at = f"{tmp_path}/l"
    sinks.bucketed(df, at, "people", "name", 4)
    assert sinks.lookup_status(spark, at, "people", "a", "name", 4) == "found"
    assert sinks.lookup_status(spark, f"{at}-none", "people", "a", "name", 4) == "data_state_error"
    with pytest.raises(TypeError):
        sinks.lookup_status(spark, at, "people", "a", "name", None)  # a caller's mistake
    for folder, _, names in os.walk(sinks.current(spark, at)):
        for n in names:
            os.remove(f"{folder}/{n}")
            if n.endswith(".parquet"):
                with open(f"{folder}/{n}", "w") as f:
                    f.write("damaged, and long enough to look like a file")
    assert sinks.lookup_status(spark, at, "people", "a", "name", 4) == "data_state_error"


def test_only_meeting_blocks_are_decoded(spark, tmp_path):
    # the first gram is everywhere, the others only near the end
    rows = [(i, "red bolt" if i > 4000 else "red nut" if i % 2 else "bolt") for i in range(1, 4401)]
    df = spark.createDataFrame(rows, "ordinal long, t string")
    at = f"{tmp_path}/p"
    postings.build(df, "ordinal", [F.col("t")], at, buckets=8, page=256)
    blocks = spark.read.parquet(at)
    _, grams = search._wanted("red bolt")
    meeting = postings.meeting(blocks, grams, 8)
    listed = blocks.where(F.col("gram").isin(grams))
    assert meeting.count() == 3 * len(grams) < listed.count()  # pages 15, 16 and 17 of 18
    assert "bucket" in (p := plan_of(listed.where("bucket = 1")))[p.index("PartitionFilters") :].split("]")[0]
    got = postings.search_stored(spark, at, df, "ordinal", ["t"], "Red  bolt", 8)
    assert sorted(r["ordinal"] for r in got.collect()) == list(range(4001, 4401))
    assert postings.search_stored(spark, at, df, "ordinal", ["t"], "re", 8).count() == 0


def test_differences_of_longs(spark):
    lists = [[], [1], [127, 128, 129], [1 << 40, (1 << 62) + 5], [300]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>")
    assert [r["y"] for r in df.select(hashing.unpack_differences(hashing.pack_differences(F.col("x"))).alias("y")).collect()] == lists
    for bad in ([0, 1], [3, 3], [5, 4]):
        with pytest.raises(Exception, match="strictly increasing"):
            spark.createDataFrame([(bad,)], "x array<bigint>").select(hashing.pack_differences(F.col("x"))).collect()


def test_bitmaps_are_sets(spark):
    r = random.Random(1)
    sets = {k: set(r.sample(range(1, 100_000), 3000)) for k in "abc"}
    whole = set(range(1, 100_001))
    rows = spark.createDataFrame([(k, o) for k, s in sets.items() for o in s] + [("a", 7), ("a", 7), (None, 1)], "f string, o long")
    sets["a"].add(7)
    index, every = bitmaps.build(rows, "f", "o"), bitmaps.everything(spark.range(1, 100_001), "id")
    read = lambda b: {x["ordinal"] for x in bitmaps.ordinals(b).collect()}
    one = lambda k: bitmaps.any_of(index, [k])
    assert read(bitmaps.any_of(index, ["a", "b"])) == sets["a"] | sets["b"]
    assert read(bitmaps.all_of([one("a"), one("b")])) == sets["a"] & sets["b"]
    assert read(bitmaps.without(every, [one("a"), one("c")], "and")) == whole - (sets["a"] | sets["c"])
    assert read(bitmaps.without(every, [one("a"), one("c")], "or")) == whole - (sets["a"] & sets["c"])
    assert read(bitmaps.without(every, [bitmaps.any_of(index, ["none"])])) == whole
    assert index.count() <= 3 * 4 and bitmaps.without(every, [one("a")]).agg(bitmaps.count().alias("n")).first()["n"] == 100_000 - len(sets["a"])


def test_sketches_merge_within_their_bounds(spark):
    r = random.Random(2)
    values = [int(r.paretovariate(1.2)) for _ in range(30_000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "b int, n long").repartition(6)
    got = sketches.merged_quantiles(sketches.count_sketches(df, ["b"], "n")).first()
    ordered = sorted(values)
    assert (got["n"], got["min"], got["max"]) == (30_000, ordered[0], ordered[-1])
    for name, q in sketches.QUANTILES:
        lo, hi = bisect.bisect_left(ordered, got[name]) / 30_000, bisect.bisect_right(ordered, got[name]) / 30_000
        assert lo - sketches.rank_error() <= q <= hi + sketches.rank_error()
    names = spark.createDataFrame([(f"n{i % 6}", i // 2) for i in range(40_000)], "norm string, rec long")
    mapping = spark.createDataFrame([(f"n{i}", f"n{i // 3 * 3}") for i in range(6)], "norm string, target string")
    held = sketches.record_sketches(names, ["norm"], "rec")
    merged = sketches.merged_names(held, mapping)
    exact = {x["norm"]: x["n"] for x in names.join(mapping, "norm").groupBy(F.col("target").alias("norm")).agg(F.count_distinct("rec").alias("n")).collect()}
    for x in merged.select("norm", sketches.distinct(F.col("records_hll")).alias("h"), sketches.distinct(F.col("records_theta"), "theta").alias("t")).collect():
        assert abs(x["h"] - exact[x["norm"]]) <= 0.04 * exact[x["norm"]] and abs(x["t"] - exact[x["norm"]]) <= 0.04 * exact[x["norm"]]
    a, b = (merged.where(F.col("norm") == n).select(F.col("records_theta").alias(n)) for n in ("n0", "n3"))
    both = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select(sketches.shared_records(F.col("n0"), F.col("n3")).alias("s")).first()["s"]
    want = len({i // 2 for i in range(40_000) if i % 6 < 3} & {i // 2 for i in range(40_000) if i % 6 >= 3})
    assert abs(both - want) <= 0.1 * exact["n0"]


def test_points_meet_their_intervals(spark):
    r = random.Random(3)
    spans = [(r.choice("ab"), *sorted(r.sample(range(60), 2)), i) for i in range(80)] + [("a", 5, 5, 900), ("b", 9, 3, 901), ("c", 0, 59, 902)]
    points = [(k, p) for k in "abcd" for p in range(0, 60, 3)]
    day = lambda i: f"2020-{i // 28 + 1:02d}-{i % 28 + 1:02d}"
    iv = spark.createDataFrame([(k, day(a), day(z), v) for k, a, z, v in spans], "k string, a string, z string, value int")
    pt = spark.createDataFrame([(k, day(p)) for k, p in points], "k string, d string")
    dates, levels = intervals.places((pt, "d"), (iv, "a"), (iv, "z"))
    nodes = intervals.placed(intervals.placed(iv, "a", dates, "lo"), "z", dates, "hi")
    nodes = nodes.select("k", F.explode(intervals.cover(F.col("lo"), F.col("hi"), levels)).alias("x"), "value")
    asked = intervals.placed(pt, "d", dates, "at").withColumn("x", intervals.around(F.col("at"), levels))
    got = {(x["k"], x["d"]): x["value"] for x in intervals.least_value(asked, nodes, "k", ["d"]).collect()}
    want = {(k, day(p)): min(v) for k, p in points if (v := [v for s, a, z, v in spans if s == k and a <= p <= z])}
    assert got == want


def test_a_code_with_many_intervals(spark):
    """10^5 intervals and 2,000 dates of one code: work follows the rows, not the pairs."""
    day = "date_format(date_add(date'1900-01-01', cast({} as int)), 'yyyy-MM-dd')"
    rows = spark.range(100_000).selectExpr(
        "'X' code", "concat('title ', id) title", f"{day.format('id * 7919 % 40000')} effective_from", f"if(id % 3 = 0, null, {day.format('id * 7919 % 40000 + id % 900')}) effective_to",
        "cast(1 + id % 3 as int) priority", "concat('s', lpad(id, 6, '0')) source",
    )
    facts = spark.range(2000).selectExpr("id", "'X' code", f"if(id % 50 = 0, '', {day.format('id * 31 % 45000 - 2000')}) filed")
    got = {r["id"]: r["source"] for r in asof.choose(facts, "id", "code", "filed", rows).collect()}
    listed = [r.asDict() for r in rows.collect()]
    for f in random.Random(4).sample(facts.collect(), 25):
        best = None
        for s in listed:
            began, inside, local = s["effective_from"] <= f["filed"], False, s["priority"] == 3
            inside = began and (s["effective_to"] is None or f["filed"] <= s["effective_to"])
            tier = 6 if f["filed"] == "" else (0 if inside else 2 if began else 4) + (not local)
            date = int(s["effective_from"].replace("-", ""))
            rank = (tier, -s["priority"], date if tier in (4, 5) else -date, len(s["title"]), s["source"])
            best = min(best, rank) if best else rank
        assert got[f["id"]] == best[-1], f


def test_no_join_on_code_alone(spark):
    s = spark.createDataFrame([("c", "t", "2020-01-01", None, 1, "s")], "code string, title string, effective_from string, effective_to string, priority int, source string")
    f = spark.createDataFrame([(1, "c", "2021-01-01")], "id int, code string, filed string")
    v = s.select("code", F.lit(1).alias("pos"), "effective_from", "effective_to", F.lit("u").alias("url"))
    current = spark.createDataFrame([("c", "u", None)], "code string, url string, current_start string")
    for df in (asof.choose(f, "id", "code", "filed", s), asof.version_at(f, "id", "code", "filed", v, current)):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
        alone = [j for j in joins if j.count("=") == 1 and "code" in j]
        assert len(joins) > 3 and all("LeftOuter" in j for j in alone) and len(alone) <= 1  # the one current version of a code


def test_ties_repeats_and_null_groups(spark):
    df = spark.createDataFrame([("g", 1, 10), ("g", 1, 20), ("g", 2, 5), (None, 1, 7), (None, None, 9)], "g string, o int, s int")
    got = sorted(map(tuple, bands.pack_parts(df, "g", "o", "s", 20, 30).collect()), key=str)
    assert got == sorted([("g", 1, 10, 0), ("g", 1, 20, 0), ("g", 2, 5, 1), (None, None, 9, 0), (None, 1, 7, 0)], key=str)
    udtfs.register(spark)
    own = spark.sql("SELECT * FROM pack_parts(TABLE({df}) PARTITION BY g ORDER BY (o, s), 's', 20, 30)", df=df)
    assert sorted(map(tuple, own.collect()), key=str) == got
    with pytest.raises(Exception, match="no column 'nope'"):
        spark.sql("SELECT * FROM pack_parts(TABLE({df}) PARTITION BY g ORDER BY (o), 'nope', 20, 30)", df=df).collect()
    assert bands.parts_by_count(df, "g", [F.col("o")], 2).count() == 5
    assert routes.record_places(df.where("g is null"), "k", "g", "o").count() == 2


def test_repeated_records_keep_a_row_each(spark):
    r = '{"title": "A v. B", "docket_entries": [{"filed": "2020-01-02", "text": "Complaint"}, {"text": "no date"}], "parties": [{"name": "Ann", "attorneys": "Fox, Jo; Fox, Jo"}]}'
    df = spark.createDataFrame([("k", r), ("k", r), (None, r), ("e", "{}"), ("bad", "nope"), ("n", None)], "k string, r string")
    facts = caseparts.case_facts(df, "k", "r").collect()
    assert sorted((str(x["k"]), x["docket_events"], x["parties"], x["representation_edges"], x["filing_date"]) for x in facts) == [("None", 2, 1, 1, "2020-01-02"), ("bad", 0, 0, 0, ""), ("e", 0, 0, 0, ""), ("k", 2, 1, 1, "2020-01-02"), ("k", 2, 1, 1, "2020-01-02"), ("n", 0, 0, 0, "")]
    plan = plan_of(caseparts.case_facts(df, "k", "r"))
    assert "Exchange" not in plan and "Join" not in plan
    parts = caseparts.case_parts(df.limit(1), "k", "r").orderBy("part", "place").collect()
    assert [(x["part"], x["place"], x["idx"]) for x in parts] == [("docket_events", 0, 1), ("docket_events", 1, 0), ("parties", 0, 0), ("representation_edges", 0, None)]


def test_unknown_namespaces_are_text(spark):
    df = spark.createDataFrame([("C1", "see http://x.y now", 2001), ("C2", "foo:bar", 2002), ("C3", "was -from:2001", 2003)], "case_number string, case_title string, year int")
    find = lambda q: [r["case_number"] for r in search.directory(df, search.parse_query(q)).collect()]
    assert find("see http://x.y") == ["C1"] and find("foo:bar") == ["C2"] and find("-from:2001") == ["C3"]
    assert find("foo:bar from:2002") == ["C2"] and find("foo:bar from:2003") == [] and find("-case-title:see from:2002") == ["C2", "C3"]
    with pytest.raises(ValueError, match="no column"):
        search.directory(df, search.Query(clauses=[search.Clause("nope", "contains", "x")]))


def test_both_label_rules_agree(spark):
    r = random.Random(6)
    pieces = ["AND", "or", "A.D.A.", "AND/OR", "UCL", "FRAUD", "(", ")", "§", "B.P.C.", "O'NEIL", "CROSS-CLAIM", ";", ".", "&", "1", "ÉTAT", "of", "(Alt.)", "THE", ",", "inc."]
    labels = [r.choice(["", " "]).join(r.choice(pieces) for _ in range(r.randint(0, 6))) for _ in range(400)] + ["VIOLATION OF A.D.A.", "OF COUNSEL", "", "AND FRAUD;"]
    got = [x["p"] for x in spark.createDataFrame([(x,) for x in labels], "t string").select(text.pretty_label(F.col("t")).alias("p")).collect()]
    assert got == [pretty(x) for x in labels]
    assert got[-4:] == ["Violation of A.D.A", "Of Counsel", "", "Fraud"]


def test_charges_of_unknown_codes_and_nothing(spark):
    cases = spark.createDataFrame([(1, "PC 459 / F; nothing known", "2020-05-05"), (2, None, None), (1, "PC 459 / F", "1990-01-01")], "k int, t string, filed string")
    none = spark.createDataFrame([], "code string, title string, effective_from string, effective_to string, priority int, source string")
    versions = spark.createDataFrame([], "code string, pos int, effective_from string, effective_to string, url string")
    current = spark.createDataFrame([("PC 459", "now", "2000-01-01")], "code string, url string, current_start string")
    got = charges.full(cases, "k", "t", "filed", none, versions, current).select("k", "pos", "title", "title_source", "url", "url_version_status").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, 0, "Penal Code § 459", "programmatic_citation", "now", "current_version_at_or_before_filing"), (1, 1, "nothing known", "raw_index_text", None, None),
        (1, 0, "Penal Code § 459", "programmatic_citation", None, "current_version_postdates_filing"),
    ], key=str)
