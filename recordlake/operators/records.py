"""Facts of a record: scan state, completeness, provenance, documents, statutes, tags, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import CHARGE_WORDS, DOCKET_STATUTE, PROCEDURAL_STATUTE, TAG_AUTHORITY

# Explicit scan states and the state they stand for.
EXPLICIT_STATES = {
    "discovered": "discovered",
    "not_found": "not-found",
    "not-found": "not-found",
    "restricted": "restricted",
    "no_docs": "no-docs",
    "no-docs": "no-docs",
    "indexed_no_docs": "no-docs",
    "summary_only": "summary-only",
    "partial_docs": "partial-docs",
    "indexed": "indexed",
    "complete": "complete",
    "core_docs": "essential",
    "essential": "essential",
}


def scan_state(state: Column, docs: Column, with_bytes: Column, deferred: Column, captured: Column, scope: Column, archive: Column, captured_at: Column) -> Column:
    """The explicit state, else ordered rules on counts (unknown counts fail every comparison)."""
    s = F.lower(F.trim(F.coalesce(state, F.lit(""))))
    out = F.lit(None).cast("string")
    for k, v in EXPLICIT_STATES.items():
        out = F.when(s == k, v).otherwise(out)
    done = F.coalesce(captured, F.lit(False))
    rules = (
        F.when((F.lower(archive) == "discovered") & (F.coalesce(captured_at, F.lit("")) == ""), "discovered")
        .when((docs == 0) & done, "no-docs")
        .when((F.lower(scope) == "docket-only") | ((docs > 0) & (with_bytes == 0)), "summary-only")
        .when((deferred > 0) & (with_bytes.isNull() | (with_bytes == 0)), "summary-only")
        .when(docs == 0, "summary-only")
        .when((docs > 0) & (with_bytes > 0), "partial-docs")
        .when((with_bytes > 0) & ~done, "essential")
        .otherwise("indexed")
    )
    return F.coalesce(out, rules)


def openable(number: Column, state: Column) -> Column:
    return (F.trim(F.coalesce(number, F.lit(""))) != "") & ~state.isin("discovered", "not-found")


def completeness(records: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One count per part table (each aggregated before its left join)."""
    out = records.select(key)
    for name, part in parts.items():
        out = out.join(part.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def provenance_mode(unavailable: Column, documents: Column, docket: Column, no_documents: Column, deferred: Column, pending: Column, available: Column, missing: Column, captured: Column, failures: Column, updated: Column, captured_at: Column) -> Column:
    partial = (deferred > 0) | (pending > 0) | ((available > 0) & (missing > 0) & ~F.coalesce(captured, F.lit(False))) | (failures > 0)
    mode = F.when(unavailable & (documents == 0) & (docket == 0), "unavailable").when(no_documents, "no_documents").when(partial, "partial").otherwise("complete")
    return F.when((F.coalesce(updated, F.lit("")) != "") & ~updated.eqNullSafe(captured_at), "updated").otherwise(mode)


def provenance(documents: DataFrame, key: str, cases: DataFrame) -> DataFrame:
    """Counts of a case's documents, its release tags and the mode of its capture.

    documents: key, available, held (bytes are archived), deferred, tag; cases:
    key, unavailable, docket, no_documents, pending, captured, failures,
    updated_at, captured_at.
    """
    open_ = F.coalesce("available", F.lit(True))
    by = documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("documents_total"), F.count_if("held").alias("documents_with_bytes"), F.count_if(~open_).alias("documents_unavailable"),
        F.count_if(open_ & ~F.col("held") & F.col("deferred")).alias("documents_deferred"), F.count_if(open_).alias("open"),
        F.array_sort(F.collect_set(F.nullif(F.trim("tag"), F.lit("")))).alias("release_tags"),
    )
    out = cases.join(by, key, "left")
    numbers = ("documents_total", "documents_with_bytes", "documents_unavailable", "documents_deferred", "open")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers})
    out = out.withColumn("documents_bytes_missing", F.greatest(F.lit(0), F.col("open") - F.col("documents_deferred") - F.col("documents_with_bytes")))
    mode = provenance_mode(
        F.col("unavailable"), F.col("documents_total"), F.col("docket"), F.col("no_documents"), F.col("documents_deferred"), F.col("pending"), F.col("open"),
        F.col("documents_bytes_missing"), F.col("captured"), F.col("failures"), F.col("updated_at"), F.col("captured_at"),
    )
    changed = F.coalesce(F.nullif(F.trim(F.coalesce("updated_at", F.lit(""))), F.lit("")), F.col("captured_at"))
    tags = F.coalesce("release_tags", F.array().cast("array<string>"))
    return out.select(key, *numbers[:-1], "documents_bytes_missing", tags.alias("release_tags"), changed.alias("last_changed"), mode.alias("mode"))


def date_order(filed: Column, doc_id: Column, idx: Column) -> list[Column]:
    """Documents in order: dated ones by date, then id, then place in the list; the others last."""
    return [F.nullif(F.trim(filed), F.lit("")).asc_nulls_last(), F.coalesce(doc_id.cast("string"), F.lit("")), idx]


def docket_documents(documents: DataFrame, docket: DataFrame, key: str, doc: str) -> DataFrame:
    """All documents, and docket rows whose document is not among them."""
    extra = docket.where(F.col(doc).isNotNull()).join(documents.select(key, doc), [key, doc], "left_anti")
    return documents.withColumn("origin", F.lit("document")).unionByName(extra.select(*documents.columns).withColumn("origin", F.lit("docket")))


def document_for_event(events: DataFrame, by_id: DataFrame, by_row: DataFrame, by_text: DataFrame) -> DataFrame:
    """Document of an event: its own id, its docket row's, or one of the same description, in that order."""
    out = events.join(by_id.select(F.col("doc_id").alias("direct_id"), F.col("doc_id").alias("a")), "direct_id", "left")
    out = out.join(by_row.select("row_index", F.col("doc_id").alias("b")), "row_index", "left")
    least = by_text.groupBy("description").agg(F.min("doc_id").alias("c"))
    out = out.join(least, "description", "left")
    return out.select("event_id", F.coalesce("a", "b", "c").alias("doc_id"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "row").when(F.col("c").isNotNull(), "text").otherwise("none").alias("matched_by"))


def edges(rows: DataFrame, party: str, attorney: str, field: str, pos: str) -> DataFrame:
    """Distinct party-attorney edges (ignoring case), the first of each."""
    key = F.lower(F.concat_ws("|", party, attorney, field))
    return rows.withColumn("edge_key", key).groupBy("edge_key").agg(F.min_by(F.struct(party, attorney, field), pos).alias("e")).select("edge_key", "e.*")


def statute_code(x: Column) -> Column:
    """Canonical text of a cited statute."""
    s = F.regexp_replace(F.regexp_replace(text.clean_inline(x), r"(?i)\bPEN(?:AL)?\s+CODE\b", "PC"), r"(?i)\bSECTION\b|\bSEC\.|§", "")
    return F.upper(text.clean(s))


def statute_hits(lines: DataFrame, key: str, line: str, source: str) -> DataFrame:
    """Statutes cited in distinct lines of a record: hits, sources, class and whether a line speaks of a charge."""
    cleaned = lines.select(key, source, text.clean_inline(F.col(line)).alias("line")).where("line <> ''")
    once = cleaned.groupBy(key, F.upper("line").alias("u")).agg(F.min_by(F.struct("line", source), source).alias("x")).select(key, "x.line", F.col(f"x.{source}").alias(source))
    hits = once.select(key, source, "line", F.explode(F.regexp_extract_all("line", F.lit(DOCKET_STATUTE), F.lit(0))).alias("hit"))
    spaced = F.regexp_replace(statute_code(F.col("hit")), r"^([A-Z]+)\s*(\d)", "$1 $2")
    hits = hits.withColumn("code", spaced).withColumn("candidate", F.col("line").rlike(CHARGE_WORDS))
    by = hits.groupBy(key, "code").agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.sort_array(F.collect_set(source)), "|").alias("sources"), F.max("candidate").alias("charge_candidate"))
    kind = F.when(F.col("code").rlike(PROCEDURAL_STATUTE), "procedural").when(F.col("charge_candidate"), "charge_candidate").otherwise("unknown")
    return by.withColumn("classification", kind)


def resolve_tags(tags: DataFrame, key: str, truth: dict[str, str], tentative: tuple[str, ...] = ("tentative",)) -> DataFrame:
    """Per (record, namespace): the namespace's source of truth, else the highest authority; dotted if all are tentative."""
    rank = F.lit(0)
    for source, n in TAG_AUTHORITY.items():
        rank = F.when(F.col("source") == source, n).otherwise(rank)
    is_truth = F.lit(False)
    for ns, source in truth.items():
        is_truth = F.when((F.col("namespace") == ns) & (F.col("source") == source), True).otherwise(is_truth)
    order = F.struct(is_truth.cast("int"), rank, F.col("value"))
    return tags.groupBy(key, "namespace").agg(
        F.max_by(F.struct("value", "source"), order).alias("t"), F.bool_and(F.col("source").isin(*tentative)).alias("dotted")
    ).select(key, "namespace", "t.value", "t.source", "dotted")


def valid_tags(tags: DataFrame, allowed: dict[str, tuple[str, ...]], values: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a tag's namespace admits its source, and its value where the namespace lists them."""
    out = F.lit(False)
    for ns, sources in allowed.items():
        ok = F.col("source").isin(*sources)
        if values and ns in values:
            ok = ok & F.col("value").isin(*values[ns])
        out = F.when(F.col("namespace") == ns, ok).otherwise(out)
    return out


def state_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[ -]+", "_")


def current_event(events: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """First event that matches the record's hashes in order, else the last operative one.

    `events` has hashes (array), status and pos; the wanted columns are the
    record's hash pointers in priority order.
    """
    priority = F.lit(len(wanted))
    for i in reversed(range(len(wanted))):
        priority = F.when(F.coalesce(F.array_contains("hashes", F.col(wanted[i])), F.lit(False)), i).otherwise(priority)
    operative = F.col("status").isin("operative", "superseding")
    usable = events.withColumn("_p", priority).where((F.col("_p") < len(wanted)) | operative)
    order = F.struct(F.col("_p"), F.when(F.col("_p") < len(wanted), F.col("pos")).otherwise(-F.col("pos")))
    return usable.groupBy(key).agg(F.min_by("event_id", order).alias("event_id"))


def case_status(no_data: Column, satisfied: Column, closure: Column, effect: Column, valid_closure: Column, vacated: Column, evidence: Column, explicit_open: Column) -> Column:
    """no data > satisfied > terminated > vacated > evidence > open > unknown."""
    state = state_name(closure)
    ended = state.isin("terminated", "closed", "whole_case_terminated") & (state_name(effect) == "closes_case") & valid_closure & ~vacated
    open_ = state.isin("open", "active", "pending", "affirmatively_open") | explicit_open
    return (
        F.when(no_data, "unavailable").when(satisfied, "judgment_satisfied").when(ended, "case_terminated")
        .when(vacated & evidence, "disposition_vacated").when(evidence, "disposition_evidence")
        .when(open_, "affirmatively_open").otherwise("unknown")
    )


def valid_summaries(df: DataFrame, count: str, cases: str, total: str, largest: str) -> Column:
    """Money that is finite, not negative and consistent."""
    money = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) >= 0)
    return money(total) & money(largest) & (F.col(count) > 0) & (F.col(cases) <= F.col(count)) & (F.col(largest) <= F.col(total))


def cents(x: Column) -> Column:
    """Half-up on the binary double."""
    return F.floor(x * 100 + 0.5) / 100


def amendment(description: Column) -> Column:
    """How often a pleading has been amended, by the words of its description."""
    d, rank = F.upper(F.coalesce(description, F.lit(""))), F.lit(0)
    for i, word in ((1, r"FIRST\b|\b1(?:ST)?\b\s*AMEND|\bAMENDED\b"), (2, r"SECOND\b|\b2(?:ND)?\b\s*AMEND"), (3, r"THIRD\b|\b3(?:RD)?\b\s*AMEND"), (4, r"FOURTH\b|\b4(?:TH)?\b\s*AMEND"), (5, r"FIFTH\b|\b5(?:TH)?\b\s*AMEND")):
        rank = F.when(d.rlike(rf"\b{word}"), i).otherwise(rank)
    return rank


def latest_pleading(rows: DataFrame, key: str, description: str, filed: str, pos: str) -> DataFrame:
    """Operative complaint: highest amendment, then latest, then first listed."""
    w = Window.partitionBy(key).orderBy(amendment(F.col(description)).desc(), F.col(filed).desc(), pos)
    return rows.withColumn("amendment", amendment(F.col(description))).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
