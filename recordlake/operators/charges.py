"""Charges in full: every citation of an index text with its title of the filing date, its schedule row and the law's address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import code_base, version_at, with_fallback_key
from .lineage import cut
from .captions import charge_title, law_url, parse_charges

#: Columns of a schedule row that a charge shows, as title_schedule_<name>.
SCHEDULE = (
    "source", "source_label", "source_url", "source_page", "jurisdiction", "effective_from", "effective_to", "schedule_classification",
    "doj_cjis_code", "doj_offense_level", "doj_possible_sentence",
)


def _given(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))


def full(cases: DataFrame, key: str, index_text: str, filed: str, schedule: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """(key, pos and fields) of the charges of every case.

    schedule: code ("PC 459"), title, title_source, priority and the SCHEDULE columns; a charge
    meets the rows of its full section, or those of the section without
    subdivisions where there are none.  versions (code, pos, effective_from, effective_to, url)
    and current (code, url, current_start) are texts of the law by section.  A citation that cannot be
    read keeps its words; cases that repeat a key have rows each.
    """
    rows = cases.select(F.col(key).alias("_key"), F.col(filed).alias("_filed"), F.posexplode(parse_charges(F.col(index_text))).alias("pos", "c"))
    rows = rows.withColumn("_id", F.struct(F.col("_key"), F.xxhash64("_filed"), F.col("pos")))
    cited = F.col("c.code_system").isNotNull()
    law = F.concat_ws(" ", F.col("c.code_system"), code_base(F.col("c.section")))
    rows = rows.withColumn("_exact", F.when(cited, F.col("c.code"))).withColumn("_base", F.when(cited, law))
    rows = cut(rows)  # texts are parsed once
    facts = rows.where(cited).select("_id", "_exact", "_base", "_filed").distinct()
    for c in (*SCHEDULE, "title_source"):
        if c not in schedule.columns:
            schedule = schedule.withColumn(c, F.lit(None).cast("string"))
    carry = tuple(c for c in (*SCHEDULE, "title_source") if c not in ("source", "effective_from"))
    chosen = with_fallback_key(facts, "_id", "_exact", "_base", "_filed", schedule, carry)
    chosen = chosen.select("_id", F.struct(*[c for c in chosen.columns if c != "_id"]).alias("s"))
    texts = version_at(facts, "_id", "_base", "_filed", versions, current).select("_id", F.struct("url", "status").alias("v"))
    x = rows.join(chosen, "_id", "left").join(texts, "_id", "left")
    title = charge_title(F.col("c.provided_title"), F.col("s.title"), F.col("s.title_source"), F.col("c.citation"), F.col("c.title"))
    shown = [_given(F.col(f"s.{n}")).alias(f"title_schedule_{n}") for n in SCHEDULE]
    x = x.withColumn("t", title)
    return x.select(
        F.col("_key").alias(key), "pos", F.col("c.raw").alias("raw"), F.col("t.title").alias("title"), F.col("t.title_source").alias("title_source"), F.col("t.schedule_title").alias("schedule_title"),
        F.col("s.status").alias("title_version_status"), *shown, F.col("c.code").alias("code"), F.col("c.code_system").alias("code_system"), F.col("c.section").alias("section"),
        F.col("c.citation").alias("citation"), F.col("c.classification").alias("classification"), F.when(cited, F.coalesce(_given(F.col("v.url")), F.when(F.col("v.status") == "no_version", _given(law_url(F.col("c.code_system"), F.col("c.section")))))).alias("url"),
        F.when(cited, F.col("v.status")).alias("url_version_status"),
    )
