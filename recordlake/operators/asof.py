"""Effective-dated lookups with tiers of fallback; dates are ISO text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .intervals import around, cover, least_value, placed, places
from .lineage import cut

STATUSES = (
    "effective_at_filing",
    "effective_at_filing_supplemental_source",
    "latest_available_before_filing",
    "latest_available_before_filing_supplemental_source",
    "earliest_available_after_filing",
    "earliest_available_after_filing_supplemental_source",
)
UNDATED = "latest_available_no_filing_date"


def choose(facts: DataFrame, fact_id: str, key: str, filed: str, schedule: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The best schedule row (code, title, effective_from, effective_to, priority, source) of each fact, with the columns `carry`.

    Of the schedule rows of one code with one interval only the best can ever win,
    so the others go first.  The tie-breaks do not depend on the fact, so the rest
    is ranked once inside its code, latest first and earliest first, and a row's tier
    and rank make one long.  A row offers this long over the dates where it would have
    that tier: in force, begun (only reached where nothing of the better tiers covers the
    date), and any date.  Distinct (code, date) pairs take the least long around them (see
    intervals), so no pair of a date and an interval is ever made; the winner's columns are joined back.
    """
    s = schedule.where((F.trim("title") != "") & ~F.lower(F.trim("title")).isin("a", "an", "and", "for", "nor", "of", "or", "the", "to", "with"))
    start, end = F.coalesce("effective_from", F.lit("")), F.coalesce("effective_to", F.lit(""))
    upper = F.upper("title")
    general = F.when(~upper.contains(":") & ~upper.contains(" - "), 2).otherwise(0) + F.when(~upper.rlike(r"\b(?:FIRST|SECOND|THIRD|1ST|2ND|3RD)\s+DEGREE\b"), 1).otherwise(0)
    number = F.when(start.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(start, F.lit("-"), F.lit("")).cast("int")).otherwise(0)
    s = s.withColumns({"_general": general, "_number": number, "_start": start, "_end": end, "_local": F.coalesce(F.col("priority") == 3, F.lit(False))})
    s = s.groupBy("code", "_start", "_end", "_local", "_number").agg(
        F.min_by(F.struct("title", "effective_from", "priority", "source", "_general", *carry), F.struct(-F.col("priority"), -F.col("_general"), F.length("title"), F.col("source"))).alias("x")
    ).select("code", "_start", "_end", "_local", "_number", "x.*")

    def rank(by_date: Column) -> Column:
        order = [F.col("priority").desc(), F.col("_general").desc(), by_date, F.length("title"), F.col("source")]
        return F.row_number().over(Window.partitionBy("code").orderBy(*order)).cast("long")

    ranked = s.withColumn("_late", rank(F.col("_number").desc())).withColumn("_early", rank(F.col("_number").asc()))
    f = facts.select(fact_id, F.col(key).alias("code"), F.coalesce(F.col(filed), F.lit("")).alias("_filed"))
    pairs, ranked = cut(f.where("code is not null").select("code", "_filed").distinct()), cut(ranked)
    dates, levels = places((pairs, "_filed"), (ranked, "_start"), (ranked, "_end"))
    undated = F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node"))  # where facts without a date meet all rows of their code
    end_of_time = F.lit((1 << levels) - 1).cast("long")
    points = placed(pairs, "_filed", dates, "_at")
    points = points.withColumn("x", F.when(F.col("_filed") == "", F.array(undated)).otherwise(around(F.col("_at"), levels)))
    rows = placed(placed(ranked.select("code", "_start", "_end", "_local", "_late", "_early"), "_start", dates, "_first"), "_end", dates, "_last")
    start, end, always = F.col("_first"), F.when(F.col("_end") == "", end_of_time).otherwise(F.col("_last")), cover(F.lit(0).cast("long"), end_of_time, levels)
    worse = F.when(F.col("_local"), 0).otherwise(1).cast("long")
    offer = lambda tier, rank, x: F.transform(x, lambda node: F.struct(node.alias("x"), (F.shiftleft(tier.cast("long"), 40) + F.col(rank)).alias("value")))
    offers = F.concat(
        offer(worse, "_late", cover(start, end, levels)), offer(worse + 2, "_late", cover(start, end_of_time, levels)),
        offer(worse + 4, "_early", always), offer(F.lit(6), "_late", F.array(undated)),
    )
    nodes = rows.select("code", F.explode(offers).alias("o")).select("code", "o.x", "o.value")
    best = least_value(points, nodes, "code", ["_filed"]).withColumnRenamed("value", "_score")
    best = best.withColumn("_tier", F.shiftright("_score", 40).cast("int")).withColumn("_rank", F.col("_score").bitwiseAND(F.lit((1 << 40) - 1)))
    best = best.withColumn("_from_early", F.col("_tier").isin(4, 5))
    both = F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("_late").alias("r")), F.struct(F.lit(True).alias("e"), F.col("_early").alias("r")))).alias("x")
    winners = ranked.select("code", "title", "effective_from", "source", *carry, both).select("code", "title", "effective_from", "source", *carry, F.col("x.e").alias("_from_early"), F.col("x.r").alias("_rank"))
    status = F.element_at(F.array(*map(F.lit, (*STATUSES, UNDATED))), F.col("_tier") + 1)
    answers = best.join(winners, ["code", "_from_early", "_rank"]).select("code", "_filed", "title", "effective_from", "source", *carry, status.alias("status"))
    return f.join(answers, ["code", "_filed"]).select(fact_id, "title", "effective_from", "source", *carry, "status")


def with_fallback_key(facts: DataFrame, fact_id: str, exact: str, base: str, filed: str, schedule: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """choose by the exact key, and by the base key only where that finds nothing."""
    first = cut(choose(facts, fact_id, exact, filed, schedule, carry))  # read twice
    rest = facts.join(first.select(fact_id), fact_id, "left_anti")
    return first.union(choose(rest, fact_id, base, filed, schedule, carry))


def version_at(facts: DataFrame, fact_id: str, key: str, filed: str, versions: DataFrame, current: DataFrame) -> DataFrame:
    """(id, url, status): the first listed version in force, else the current one if it had begun."""
    f = facts.select(fact_id, F.col(key).alias("code"), F.coalesce(F.col(filed), F.lit("")).alias("f"))
    # of the versions of one interval the first counts, and facts of one code and date have one answer
    first = versions.where("effective_from is not null").groupBy("code", "effective_from", "effective_to").agg(F.min(F.struct("pos", "url")).alias("value"))
    first = first.withColumn("last", F.coalesce("effective_to", F.lit("9999")))
    pairs = cut(f.where("f <> '' and code is not null").select("code", "f").distinct())
    dates, levels = places((pairs, "f"), (first, "effective_from"), (first, "last"))
    points = placed(pairs, "f", dates, "_at").withColumn("x", around(F.col("_at"), levels))
    rows = placed(placed(first, "effective_from", dates, "_first"), "last", dates, "_last")
    nodes = rows.select("code", F.explode(cover(F.col("_first"), F.col("_last"), levels)).alias("x"), "value")
    hit = least_value(points, nodes, "code", ["f"]).select("code", "f", F.col("value.url").alias("historical"))
    j = f.join(hit, ["code", "f"], "left").join(current.select("code", F.col("url").alias("current_url"), "current_start"), "code", "left")
    late = (F.col("f") != "") & (F.col("f") < F.col("current_start"))
    status = (
        F.when(F.col("historical").isNotNull(), "historical_version_at_filing")
        .when(F.col("current_url").isNull(), "no_version")
        .when(late, "current_version_postdates_filing")
        .when(F.col("f") == "", "current_version_filing_date_unknown")
        .when(F.col("current_start").isNull(), "current_version_unverified")
        .otherwise("current_version_at_or_before_filing")
    )
    url = F.when(F.col("historical").isNotNull(), F.col("historical")).when(late, None).otherwise(F.col("current_url"))
    return j.select(fact_id, url.alias("url"), status.alias("status"))


def code_base(section: Column) -> Column:
    return F.regexp_replace(text.clean_inline(section), r"\(.*$", "")
