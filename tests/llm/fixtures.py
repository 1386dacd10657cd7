"""Small document tables with the hard cases: nulls, empties, ties, repeats, long texts."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=120, vocabulary=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ日") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(n):
        k = i % 10
        if k == 0:
            texts.append(None if i % 20 else "")
        elif k == 1 and texts:
            texts.append(r.choice(texts))
        elif k == 2:
            w = [r.choice(vocab) for _ in range(r.randint(5, 40))]
            texts.append(" ".join(w[:3] + passage[r.randint(0, 5) : 55] + w))
        elif k == 3:
            base = next((t for t in reversed(texts) if t and len(t) > 200), "Tail words here")
            w = base.split(" ")
            w[len(w) // 2] = "Changed"
            texts.append(" ".join(w))
        elif k == 4:
            texts.append("a " * r.randint(1, 90))
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, 150))]
            texts.append(r.choice([" ", "\n", "\t", "  "]).join(w) + r.choice(["", "\n", " "]))
    texts.append(" ".join(r.choice(vocab) for _ in range(6000)))
    rows = [(i * 3 % 1000, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "S3", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def with_extra(df):
    """Adds columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    for name in ("size", "hash", "key", "n", "id", "spans", "target", "component", "words"):
        df = df.withColumn(name, F.lit(name))
    return df
