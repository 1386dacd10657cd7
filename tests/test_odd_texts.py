"""Queries over whole texts against their SQL, on texts that read like the forms they are put into."""

import pytest

from recordlake.plans import catalog

duckdb = pytest.importorskip("duckdb")
LISTS = ["Licensed under CC BY-NC 4.0.\nÉêrépa échque.", "Licence, version 3.\nBe reed edoues.", "First cause of action: Alpha\nSecond cause of action: Beta\nThird cause of action: Gamma\nFourth cause of action: Delta",
         "COMPLAINT for\n1. Alpha 2. Beta 3. Gamma 4. Delta", "Petıtion\n1. Alpha 2. Beta 3. Gamma 4. Delta", "4. x 5. y", "1. Alpha 2. Beta 3. Gamma 4. Delta", ") 3. Gamma", "", None]
WORDS = ["The as to ofheerount", "are onwh as to", "As to the", "x filed by y", "a will annexed b", "no will filed at", "petition for as to", "ab", "and", "42", "", None]


def same(spark, tmp_path, name: str, rows: list):
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    df = catalog.QUERIES[name](spark, d)
    cur = duckdb.connect()
    cur.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    cur.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_causes_of_a_caption_end_before_the_text(spark, tmp_path):
    same(spark, tmp_path, "cause_parse", [(i, t, "en", s, 0) for i, (t, s) in enumerate((t, s) for t in LISTS for s in ("src5", "web", None))])


def test_words_of_a_petition_may_read_like_its_end(spark, tmp_path):
    same(spark, tmp_path, "petition_texts", [(i, t, "en", "s1", 0) for i, t in enumerate(WORDS)])


def test_pleadings_of_equal_causes_go_by_rank(spark, tmp_path):
    texts = [(i, "plain") for i in range(len(LISTS))] + [(200 + i, t) for i, t in enumerate(LISTS)]
    same(spark, tmp_path, "pleading_causes", [(i + 1, t, "en", "s1", 0) for i, t in texts])
