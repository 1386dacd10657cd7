import pytest
from pyspark.sql import functions as F

from recordlake.operators import asof, bands, captions, facets, identity, lineage, rankings, records, search, taxonomy


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_distinct_records_and_bands(spark):
    refs = spark.createDataFrame([(1, "CGC-98-1", None, 0), (1, "cgc981", "2001-01-01", 1), (1, "FDI-09-2", None, 2), (2, "CGC-98-1", None, 3), (2, " ", None, 4)], "e int, n string, f string, p int")
    d = bands.distinct_records(refs, "e", "n", "f", "p")
    assert rows(d) == [(1, "CGC981", "CGC-98-1", None), (1, "FDI092", "FDI-09-2", None), (2, "CGC981", "CGC-98-1", None)]
    b = {r["band"]: (r["entity_count"], r["case_count"]) for r in bands.bands(d.groupBy("e").agg(F.count("*").alias("c")), "c", True).collect()}
    assert b["1"] == (1, 1) and b["2-4"] == (1, 2) and b["0"] == (0, 0) and len(b) == 13


def test_band_edges(spark):
    c = spark.createDataFrame([(x,) for x in (0, 1, 2, 4, 5, 9999, 10000, 10**7)], "c long")
    assert [r[0] for r in c.select(bands.band_of(F.col("c"))).collect()] == [None, "1", "2-4", "2-4", "5-9", "5000-9999", "10000-plus", "10000-plus"]


def test_pack_parts(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 100, 5, 5, 5, 5])], "g string, o int, s long")
    got = {r["o"]: r["part"] for r in bands.pack_parts(df, "g", "o", "s", 3, 20).collect()}
    assert [got[i] for i in range(6)] == [0, 1, 2, 2, 2, 3]


def test_display_filter(spark):
    df = spark.createDataFrame([("Lake Trust Co", "lake trust", False), ("Lake", "Fox", False), ("Lake", "Fox", True), ("Long Lake Trust", "the long lake trust fund", False), ("", "x", False)], "d string, n string, a boolean")
    assert [r[0] for r in df.select(bands.display_is_consistent(F.col("d"), F.col("n"), F.col("a"))).collect()] == [True, False, True, True, True]


def test_facet_labels(spark):
    df = spark.createDataFrame([("Fox, LLP", "c1"), ("FOX LLP", "c2"), ("FOX LLP", "c2"), ("  ", "c3"), ("Fox, LLP", "c4")], "l string, c string")
    assert rows(facets.facet(df, "l", "c")) == [("fox llp", "FOX LLP", 3)]
    v = spark.createDataFrame([("ann lake", "Lake", 9), ("ann lake", "Hon. Ann Lake", 1), ("ann lake", "Ann Lake", 1)], "norm string, variant string, n long")
    assert rows(facets.canonical_officer_label(v)) == [("ann lake", "Hon. Ann Lake", 11)]


def test_identity_merge(spark):
    def merged(*names):
        got = identity.merge_names(spark.createDataFrame([(n,) for n in names], "norm string"))
        return {r["norm"]: r["target"] for r in got.collect()}

    assert merged("ann lake", "ann b lake", "ann bea lake", "lake") == dict.fromkeys(["ann lake", "ann b lake", "ann bea lake", "lake"], "ann bea lake")
    conflict = merged("ann lake", "ann b lake", "ann c lake", "lake")
    assert conflict == {"ann lake": "ann lake", "ann b lake": "ann b lake", "ann c lake": "ann c lake", "lake": "lake"}
    assert merged("ann fox", "bob fox", "fox")["fox"] == "fox"


def test_taxonomy_roots_with_cycle(spark):
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("o", "gone", "O")], "id string, parent_id string, label string")
    got = dict(rows(taxonomy.roots(n)))
    assert got == {"a": "A", "b": "A", "c": "A", "x": "X", "y": "Y", "o": "O"}
    chain = [(f"n{i}", f"n{i - 1}" if i else None, f"N{i}") for i in range(60)] + [("p", "q", "P"), ("q", "r", "Q"), ("r", "p", "R"), ("t", "s", "T"), ("s", "q", "S")]
    got = dict(rows(taxonomy.roots(spark.createDataFrame(chain, "id string, parent_id string, label string"))))
    assert all(got[f"n{i}"] == "N0" for i in range(60))
    assert {k: got[k] for k in "pqrst"} == {"p": "P", "q": "Q", "r": "R", "s": "Q", "t": "Q"}  # a walk ends at the cycle's first node


def test_merged_records_count_once(spark):
    r = spark.createDataFrame([("c1", "john q smith"), ("c1", "john smith"), ("c2", "john smith")], "c string, norm string")
    assert rows(identity.merged_records(r, identity.merge_names(r), "c")) == [("john q smith", 2)]


def test_query_language(spark):
    q = search.parse_query('decreed-name:"Mok Lun Wong Jow" from:2024')
    assert [(c.field, c.op, c.value) for c in q.clauses] == [("decreed_name", "contains", "Mok Lun Wong Jow")] and (q.text, q.year_min) == ("", 2024)
    q = search.parse_query('-dn:"Mok Lun" a-b:c time 10:30')
    assert [(c.field, c.op, c.value) for c in q.clauses] == [("decreed_name", "not_contains", "Mok Lun"), ("a_b", "contains", "c")] and q.text == "time 10:30"
    df = spark.createDataFrame([("C1", "Alpha old", 2023), ("C2", "Alpha kept", 2024), ("C3", "Alpha excluded", 2024), ("C4", "Beta excluded", 2024)], "case_number string, case_title string, year int")
    out = spark.createDataFrame([("C3",)], "case_number string")
    got = search.filter_directory(df, search.parse_query("alpha from:2024 to:2024"), "case_number", [F.col("case_number")], 10, out).collect()
    assert [r["case_number"] for r in got] == ["C2"] and not got[0]["overflow"]
    assert [r["case_number"] for r in search.directory(df, search.parse_query("beta")).collect()] == ["C4"]
    picked = search.Clause("case_title", "not_contains", "x", ("a", "b"))
    assert search.is_compact(search.Clause("case_title", "exact", "x"), ("case_title",)) and not search.is_compact(picked, ("case_title",))


def test_captions_of_titles(spark):
    from recordlake.functions import text

    t = ["Lake v. Fox vs. Elm et al.", "Guardianship of: Ann", "Conservatorship of Bob, et ux.", "Civil case 7", "San Francisco Superior Court case", "THE PEOPLE OF THE STATE OF CALIFORNIA v. X"]
    got = [tuple(r.p) for r in spark.createDataFrame([(x,) for x in t], "t string").select(text.title_parties(F.col("t"), F.lit(False)).alias("p")).collect()]
    assert got[:3] == [("Lake", "Fox v. Elm", None), (None, None, "Ann"), (None, None, "Bob")]
    assert got[3:5] == [(None, None, None)] * 2 and got[5] == ("People of the State of California", "X", None)


def test_ordinals_and_cap(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = rankings.ordinals(df, [F.col("v").desc(), F.col("id")]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 1001))
    assert [(-r["v"], r["id"]) for r in got] == sorted((-r["v"], r["id"]) for r in got)
    few = rankings.capped(df, [F.col("id")], 10).collect()
    assert [r["id"] for r in few] == list(range(10)) and all(r["overflow"] for r in few)
    assert not rankings.capped(df, [F.col("id")], 1000).first()["overflow"]
    assert rankings.capped(df, [F.col("id")], 0).count() == 1000


def test_search(spark):
    df = spark.createDataFrame([(1, "Red Bolt"), (2, "Redbolt"), (3, "bolted red")], "i int, t string")
    assert [r["i"] for r in search.search(df, ["t"], "red bolt").collect()] == [1]
    assert search.search(df, ["t"], "ed").count() == 0
    q = search.parse_query('judge:"Ann Lake" -party:fox from:2001 to:2003 free  words')
    assert (q.text, q.year_min, q.year_max) == ("free words", 2001, 2003)
    assert [(c.field, c.op, c.value) for c in q.clauses] == [("judge", "contains", "Ann Lake"), ("party", "not_contains", "fox")]


def test_negative_sets(spark):
    u = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "c string")
    a, b = u.where("c in ('C1','C2')"), u.where("c in ('C2','C3')")
    assert rows(search.without(u, [a, b], "c", "and")) == []
    assert rows(search.without(u, [a, b], "c", "or")) == [("C1",), ("C3",)]
    with pytest.raises(ValueError):
        search.guarded(u, 2)


def test_schedule(spark):
    s = spark.createDataFrame(
        [("A", "Old", "2000-01-01", "2000-12-31", 3, "s1"), ("A", "New: x", "2005-01-01", None, 2, "s2"), ("A", "Other", "2005-01-01", None, 1, "s3"), ("A", "the", "2000-01-01", None, 3, "s4")],
        "code string, title string, effective_from string, effective_to string, priority int, source string",
    )
    f = spark.createDataFrame([(1, "A", "2000-06-01"), (2, "A", "2003-01-01"), (3, "A", "2006-01-01"), (4, "A", ""), (5, "A", "1990-01-01")], "id int, k string, f string")
    got = {r["id"]: (r["title"], r["status"]) for r in asof.choose(f, "id", "k", "f", s).collect()}
    assert got == {
        1: ("Old", "effective_at_filing"),
        2: ("Old", "latest_available_before_filing"),
        3: ("New: x", "effective_at_filing_supplemental_source"),
        4: ("Old", "latest_available_no_filing_date"),
        5: ("Old", "earliest_available_after_filing"),
    }


def test_states(spark):
    def state(**k):
        full = {"state": None, "docs": None, "with_bytes": None, "deferred": None, "captured": None, "scope": None, "archive": None, "captured_at": None} | k
        types = {"docs": "int", "with_bytes": "int", "deferred": "int", "captured": "boolean"}
        cols = {n: F.lit(v).cast(types.get(n, "string")) for n, v in full.items()}
        return spark.range(1).select(records.scan_state(**cols)).first()[0]

    assert state() == "indexed" and state(state="Core_Docs") == "essential"
    assert state(docs=3, with_bytes=3, captured=True) == "partial-docs"
    assert state(docs=0, captured=True) == "no-docs" and state(docs=2, with_bytes=0) == "summary-only"
    assert state(archive="discovered") == "discovered" and state(with_bytes=2) == "essential"


def test_captions():
    text = "SUPERIOR COURT\nCOMPLAINT FOR:\n1. FRAUD (Civil Code § 1770(a)(5)) 2. NEGLIGENCE; and\n3. BREACH OF CONTRACT\nDEMAND FOR JURY TRIAL\n1. NOT THIS"
    got = captions.causes(text)
    assert [(c["n"], c["label"]) for c in got] == [(1, "Fraud"), (2, "Negligence"), (3, "Breach of Contract")]
    assert got[0]["statute"] == "Civil Code § 1770(a)(5"  # outer brackets are stripped from both ends
    body = "Intro\nFIRST CAUSE OF ACTION\n(Fraud)\ntext\nSECOND CAUSE OF ACTION - Negligence\n"
    assert [c["label"] for c in captions.causes(body)] == ["Fraud", "Negligence"]
    assert captions.causes(None) == [] and captions.causes("nothing here") == []


def test_charges_and_names():
    got = captions.charges("PC 459 / F; 23152(a) VEHICLE CODE M | disturbing")
    assert [(c["code"], c["classification"]) for c in got] == [("PC 459", "felony"), ("VC 23152(a)", "misdemeanor"), (None, None)]
    assert captions.attorney_names("LAKE, ANN, JR.; PRO PER; fox, bob; LAKE, ANN, JR.") == ["LAKE, ANN, JR.", "FOX, BOB"]


def test_statute_hits(spark):
    lines = spark.createDataFrame([(1, "roa", "Complaint: PC 459"), (1, "roa", "complaint: pc 459"), (1, "docket", "PC § 459 and VC 10")], "k int, s string, l string")
    assert rows(records.statute_hits(lines, "k", "l", "s")) == [(1, "PC 459", 2, "docket|roa", True, "charge_candidate"), (1, "VC 10", 1, "docket", False, "unknown")]


def test_cut_keeps_rows(spark):
    assert lineage.cut(spark.range(10)).count() == 10
