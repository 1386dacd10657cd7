import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlake.llm import stages

from .fixtures import frame
from .test_neardup import brute, near_copies
from .test_rules_huffman import junk, statistics
from .test_warc_mixing_substring import brute_removed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, *r[1:3], ["a", "b", None][i % 3], r[4]) for i, r in enumerate(junk(3) + near_copies(5, 8))]
    at = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int("%%%" not in (r[1] or "")), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_stages_take_effect(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")

    def step(stage, docs):
        out = stage(spark, docs, at)
        assert out.columns == docs.columns or stage is stages.sentencepiece
        return spark.createDataFrame(out.collect(), out.schema)

    good = step(stages.quality_rules, docs)
    bad = lambda t: statistics(t)[0] < 20 or 100 * statistics(t)[4] > 30 * statistics(t)[0] or "%%%" in t
    left = [r for r in rows if not bad(r[1] or "")]
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r[0] for r in left)
    near = step(stages.near_dedup, good)
    assert {r["doc_id"] for r in near.collect()} == {k for k, _, _, kept in brute(left) if kept}
    cut = step(stages.substring_dedup, near)
    kept = [tuple(r) for r in near.collect()]
    assert Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in cut.collect()) == Counter((k, t) for k, _, _, t in brute_removed(kept, 35).elements())
    mixed = step(stages.source_mixing, cut)
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    ids = step(stages.sentencepiece, mixed)
    assert ids.count() == mixed.count() and all(r["round_trip"] for r in ids.collect())


def test_near_dedup_decides_by_row(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(900)}" for _ in range(100)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    rows = [
        (1, near(0), "en", "a", 0), (1, near(0), "en", "a", 0), (1, near(0), "de", "a", 0),  # equal id and text
        (1, near(9), "en", "a", 0),  # another text of the id in the same group
        (2, near(3), "en", "a", 0), (2, "a text of its own", "en", "b", 0),  # one near copy of id 1, one not
        (1, "alone with a repeated id", "en", "a", 0),  # the least id of a second group
        (3, "", None, None, 0), (3, "", None, None, 0), (4, "", None, None, 0), (None, None, None, "s", 0), (None, None, None, "s", 0),
    ]
    got = Counter(tuple(x) for x in stages.near_dedup(spark, frame(spark, rows), "").collect())
    first = min((near(0), near(9)), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    want = [(1, first, "de" if first == near(0) else "en", "a", 0), rows[5], rows[6], rows[7], rows[9], rows[10]]
    assert got == Counter(want)


def test_run_chains_the_stages(spark, folder):
    at, _ = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, _ in stages.STAGES]
    assert corpus_pipeline.run(spark, at).count() > 0
