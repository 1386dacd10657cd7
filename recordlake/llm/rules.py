"""Quality rules: base statistics and a learned decision list, all in DataFrame expressions.

Sequential covering in the manner of RIPPER: a rule grows one threshold
condition at a time by FOIL gain on two thirds of the labelled rows and is
pruned to the prefix that does best on the other third; rows it covers leave,
and the next rule grows.  Every labelled row counts: each step is one small
aggregation over binned statistics (features x bins rows reach the driver).
The list becomes one ordered conditional expression.

Defined results: a null text has no words and fails the base rule; rows without
a label do not teach; repeated label rows count as often as they stand, repeated
documents are judged alike; without usable labels the list is empty and only the
base rule decides; a text of any length is taken whole (its words and windows
are arrays in one row); an empty table gives no rows; other columns are kept by
`with_statistics`, but for those with the name of a statistic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Filter, Scratch, carried, quoted, session, unpacked

SEPARATORS = r"[\x20\x09-\x0D]+"
WHITE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
SYMBOLS = list("#*$%&|<>")
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: list[str]) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeats(words: Column) -> Column:
    """Words that lie in windows found twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            def again(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, again), lambda e: e["i"]))

        def length(p: Column) -> Column:
            gap = lambda a, k: a + F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), F.lit(WINDOW), gap)

        return let(pairs, lambda s: let(places(s), length))

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        check = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
        return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows, check))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` and the statistics BASE and MORE (long) of the whole text; a column of that name gives way."""
    names = [c for c in docs.columns if c not in (*BASE, *MORE)]
    return statistics(docs, text).select(*unpacked(names), *BASE, *MORE)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`carried`, a struct of all columns of `docs`, and the statistics BASE and MORE."""
    t = F.col("body")
    words = F.array_remove(F.split(t, SEPARATORS), "")
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    extra = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select(carried(docs.columns), F.coalesce(F.col(quoted(text)), F.lit("")).alias("body"))
    values = {
        "n_words": F.col("by_word.n"),
        "word_chars": F.length(_without(t, WHITE)),
        "n_symbols": F.length(t) - F.length(_without(t, SYMBOLS)),
        "n_dup_lines": extra,
        "n_repeat_words": F.col("by_word.r"),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", "")),
        "n_marks": F.length(t) - F.length(_without(t, ["!", "?"])),
    }
    return rows.withColumn("by_word", by_word).select("carried", *[v.cast("long").alias(n) for n, v in values.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


#: What conditions may test.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "dup_lines": lambda: F.col("n_dup_lines").cast("double"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "upper_share": lambda: _share("n_upper", "word_chars"),
    "marks_per_word": lambda: _share("n_marks", "n_words"),
}


@dataclass
class DecisionList:
    """Ordered rules; a rule is a conjunction of (feature, at_least, threshold)."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def condition(self, rule) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in rule:
            f = FEATURES[name]()
            out = out & ((f >= threshold) if at_least else (f < threshold))
        return out

    def column(self) -> Column:
        """The text of the first rule that holds, else null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(self.condition(rule), F.lit(self.text(rule))).otherwise(out)
        return out

    @staticmethod
    def text(rule) -> str:
        return " and ".join(f"{n} {'>=' if a else '<'} {t:.6g}" for n, a, t in rule)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if p <= 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(
    labelled: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    bins: int = 32,
    max_rules: int = 8,
    max_conditions: int = 3,
    precision: float = 0.95,
    least: int = 5,
) -> DecisionList:
    """Learns to reject rows whose `label` is 0 from their statistics.

    A rule stands if at least `precision` of the labelled rows it rejects (after
    pruning, over all rows left) are bad and they are at least `least`.
    """
    names = list(FEATURES)
    rows = labelled.where(F.col(label).isin(0, 1) & ~base_failed())
    rows = rows.select(
        (F.col(label) == 0).alias("bad"),
        (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(3)) == 0).alias("prune"),
        *[f().alias(n) for n, f in FEATURES.items()],
    )
    scratch = Scratch(session(labelled))
    rows = scratch.table(rows, "labelled")
    levels = [(i + 1) / (bins + 1) for i in range(bins)]
    # thresholds: quantiles of all rows and of the bad ones
    q = rows.agg(*[F.percentile_approx(n, levels, 10000).alias(n) for n in names]).first()
    b = rows.where("bad").agg(*[F.percentile_approx(n, levels, 10000).alias(n) for n in names]).first()
    cuts = {n: sorted({*(q[n] or []), *(b[n] or [])}) for n in names}
    if not b[names[0]]:
        return DecisionList()

    def bin_of(n: str) -> Column:  # number of thresholds at or below the value
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[n]]), lambda c: c <= F.col(n))).alias(n)

    binned = rows.select("bad", "prune", *[bin_of(n) for n in names]).groupBy("bad", "prune", *names).agg(F.count(F.lit(1)).alias("n"))
    left = scratch.table(binned, "binned")
    bad_n = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0))
    good_n = F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0))

    def test(cond) -> Column:
        n, at_least, k = cond
        return F.col(n) > k if at_least else F.col(n) <= k

    out = DecisionList()
    while len(out.rules) < max_rules:
        grown: list[tuple[str, bool, int]] = []
        inside = left.where("not prune")
        while len(grown) < max_conditions:
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("k")) for n in names])).alias("x")
            found = inside.select("bad", "n", pairs).groupBy("x.f", "x.k").agg(bad_n.alias("p"), good_n.alias("g")).collect()
            table = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
            for r in found:
                table[r["f"]][r["k"]] = [r["p"], r["g"]]
            p0, g0 = (sum(x[i] for x in table[names[0]]) for i in (0, 1))
            if not p0 or not g0:
                break
            best = (0.0, None)
            for n in names:
                p = g = 0
                for k in range(len(cuts[n])):  # rows with bin <= k lie below threshold k
                    p, g = p + table[n][k][0], g + table[n][k][1]
                    best = max(best, (_gain(p, g, p0, g0), (n, False, k)), (_gain(p0 - p, g0 - g, p0, g0), (n, True, k)), key=lambda x: x[0])
            if best[1] is None:
                break
            grown.append(best[1])
            inside = inside.where(test(best[1]))
        if not grown:
            break
        sums, cond = [], F.lit(True)
        for k, c in enumerate(grown):
            cond = cond & test(c)
            for split in ("prune", "true"):
                on = cond & F.expr(split)
                sums += [F.sum(F.when(on & F.col("bad"), F.col("n")).otherwise(0)).alias(f"p{k}{split}"), F.sum(F.when(on & ~F.col("bad"), F.col("n")).otherwise(0)).alias(f"g{k}{split}")]
        a = left.agg(*sums).first()

        def worth(k: int) -> float:
            p, g = a[f"p{k}prune"], a[f"g{k}prune"]
            return (p - g) / (p + g) if p + g else -1.0

        upto = max(range(len(grown)), key=lambda k: (worth(k), -k))
        p, g = a[f"p{upto}true"], a[f"g{upto}true"]
        if p < least or p < precision * (p + g):
            upto = len(grown) - 1  # the full rule may still be good enough
            p, g = a[f"p{upto}true"], a[f"g{upto}true"]
            if p < least or p < precision * (p + g):
                break
        rule, covers = grown[: upto + 1], F.lit(True)
        for c in rule:
            covers = covers & test(c)
        out.rules.append([(n, at, float(cuts[n][k])) for n, at, k in rule])
        left = left.where(~covers)
    return out


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """`stats` with base_failed, rejected_by (the rule's text or null) and kept."""
    out = stats.withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def labelled_statistics(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of the labelled documents: `stats` without its text, joined with `labels`."""
    own = labels.select(F.col(quoted(id_col)).alias("labelled_id"), F.col(quoted(label)).alias("quality"))
    on = F.col("doc_id") == F.col("labelled_id")
    return stats.select(F.col(quoted(id_col)).alias("doc_id"), *BASE, *MORE).join(own, on).drop("labelled_id")


def labelled_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of the documents that have a label; a fixed-size filter keeps the other texts out of the join."""
    scratch = Scratch(session(docs))
    ids = scratch.table(labels.select(F.col(quoted(id_col)).alias("labelled_id")).distinct(), "labelled_ids")
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    few = Filter(scratch, ids, "labelled_id", "filter").mark(rows, F.col("doc_id"), "maybe").where("maybe").drop("maybe")
    return few.join(ids, F.col("doc_id") == F.col("labelled_id"), "left_semi")


def select_kept(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, all their columns as they were."""
    return judge(statistics(docs, text), rules).where("kept").select(*unpacked(docs.columns))
