"""Outcomes in words: results, amounts, satisfaction, descriptions, fallbacks and data errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import DOMAIN_LABELS, DOMAIN_RESULTS, EVENT_LABELS, EVENT_RESULTS, MANIFEST_MESSAGES, NEVER_SATISFIED, SATISFIABLE, SUPPORT_DOMAINS
from .casefacts import review_reasons, satisfaction, valid_closure
from .records import state_name

NOTHING = "No current full satisfaction recorded."


def _trim(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def _present(x: Column) -> Column:
    return F.nullif(_trim(x), F.lit(""))


def words(x: Column) -> Column:
    """A name's underscores and slashes as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(_trim(x), "[_/]+", " "), r"\s+", " "))


def _table(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), key)


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def event_label(kind: Column) -> Column:
    return F.coalesce(_table(EVENT_LABELS, _trim(kind)), _present(words(kind)), F.lit("Event"))


def domain_label(domain: Column) -> Column:
    return F.coalesce(_table(DOMAIN_LABELS, _trim(domain)), words(domain))


def joined(items: Column) -> Column:
    """One; one and two; One, Two, and three."""
    n = F.size(items)
    last = F.lower(F.element_at(items, -1))
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n < 1, "").when(n == 1, items[0]).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def components(*lists: Column) -> Column:
    """The first list that has an entry that is not blank, without the blank ones."""
    empty = F.array().cast("array<string>")
    some = [F.filter(F.transform(F.coalesce(x, empty), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "") for x in lists]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in some], empty)


def support_label(domains: Column, current: Column) -> Column:
    """The current kind of support, else those that are present."""
    present = F.filter(F.array(*map(F.lit, SUPPORT_DOMAINS)), lambda d: F.array_contains(domains, d))
    both = (F.size(present) == 2) & F.array_contains(present, "child_support") & F.array_contains(present, "spousal_support")
    listed = joined(F.transform(present, lambda d: _table(SUPPORT_DOMAINS, d)))
    return F.coalesce(_table(SUPPORT_DOMAINS, current), F.when(both, "Child and spousal support").otherwise(listed))


def family_label(kind: Column, domains: Column, current: Column) -> Column:
    """Support and custody orders that stand together, or ''."""
    support, custody = support_label(domains, current), F.array_contains(domains, "child_custody")
    some = support != ""
    order = (
        F.when(some & custody, F.concat(support, F.lit(" and custody order entered")))
        .otherwise(F.concat(F.coalesce(_present(support), F.lit("Support")), F.lit(" order entered")))
    )
    changed = (
        F.when(some & custody, F.concat(support, F.lit(" modified; custody order also on file")))
        .otherwise(F.concat(F.coalesce(_present(support), F.lit("Support")), F.lit(" order modified")))
    )
    return (
        F.when(kind == "family_support_order", order)
        .when(kind == "family_custody_order", F.when(some, F.concat(support, F.lit(" and custody order entered"))).otherwise("Child custody order entered"))
        .when(kind == "family_support_modification", changed)
        .when(kind == "family_custody_modification", F.when(some, F.concat(F.lit("Child custody modified; "), F.lower(support), F.lit(" order also on file"))).otherwise("Child custody order modified"))
        .otherwise("")
    )


def result_label(kind: Column, domain: Column, domains: Column, parts: Column, whole_case: Column) -> Column:
    """Family composite, appeal components, dismissed case, the kind's result, the domain's, or the name recorded."""
    k, d = _trim(kind), _trim(domain)
    every = F.array_distinct(F.filter(F.concat(components(domains), F.array(d)), lambda x: x != ""))
    named = F.filter(F.transform(components(parts), words), lambda x: x != "")
    first = F.element_at(F.filter(F.transform(every, lambda x: _table(DOMAIN_RESULTS, x)), lambda x: x.isNotNull()), 1)
    known = F.when(F.size(F.filter(every, lambda x: _table(DOMAIN_RESULTS, x).isNotNull())) > 0, first)
    other = event_label(F.coalesce(_present(k), d))
    return F.coalesce(
        _present(family_label(k, every, d)),
        F.when(k.isin("appeal_mixed", "appeal_modified") & (F.size(named) > 0), F.concat(F.lit("Appeal resolved: "), joined(named))),
        F.when(F.coalesce(whole_case, F.lit(False)) & k.isin("dismissal", "judgment_of_dismissal"), "Case dismissed"),
        _table(EVENT_RESULTS, k), _table(DOMAIN_RESULTS, d), known,
        F.when(other == "Event", "Disposition recorded").otherwise(F.concat(other, F.lit(" recorded"))),
    )


def observed_label(kind: Column, parts: Column) -> Column:
    """The components seen, else the kind."""
    seen = F.array_join(F.transform(components(parts), words), " + ")
    return F.when(seen == "", event_label(kind)).otherwise(_capital(seen))


def amount(recorded: Column, renewed: Column, actual: Column, original: Column) -> Column:
    """First amount that is there."""
    return F.coalesce(*[F.when(_trim(c) != "", c) for c in (recorded, renewed, actual, original)])


def summary_of(summary: Column, operative: Column) -> Column:
    """The record's summary, else its operative one."""
    return F.coalesce(summary, operative)


def sentence(x: Column) -> Column:
    """One capital, one full stop; '' stays."""
    s = F.regexp_replace(_trim(x), "[.]+$", "")
    return F.when(s == "", "").otherwise(F.concat(_capital(s), F.lit(".")))


def final_signal(has_final: Column, no_data: Column) -> Column:
    return F.coalesce(has_final, F.lit(False)) & ~F.coalesce(no_data, F.lit(False))


def fallback_satisfaction(has_final: Column, no_data: Column, kind: Column, satisfied: Column, name_change: Column) -> Column:
    """What a case's status alone says on satisfaction."""
    no = F.coalesce(name_change, F.lit(False)) | ~state_name(kind).isin(*SATISFIABLE)
    text_ = F.when(F.coalesce(satisfied, F.lit(False)), "Satisfaction of judgment on file.").when(no, "").otherwise(NOTHING)
    return F.when(final_signal(has_final, no_data), text_).otherwise("")


def posture(reference_only: Column, fallback: Column, kind: Column, state: Column, explicit: Column, label: Column) -> Column:
    """The sentence on satisfaction, where it applies and is known."""
    unknown = (_trim(state) == "") & (_trim(explicit) == "")
    return F.when(reference_only, fallback).when(kind.isin(*NEVER_SATISFIED) | unknown, "").otherwise(sentence(label))


def fallback_amount(has_final: Column, no_data: Column, dismissed: Column, judged: Column, satisfied: Column) -> Column:
    """Why a case's status alone names no amount."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~final_signal(has_final, no_data), "Final amount: not stated.")
        .when(yes(dismissed) & ~yes(judged), "Final amount: no money judgment amount detected in the extracted case-status signal.")
        .when(yes(satisfied) & ~yes(judged), "Final amount: not stated in the extracted satisfaction signal.")
        .otherwise("Final amount: not stated in extracted ROA/document metadata.")
    )


def fallback_source(detail: Column, *snippets: Column) -> Column:
    """The first snippet that says something."""
    return text.clean(F.coalesce(_present(detail), *[_present(s) for s in snippets], F.lit("")))


def data_error(code: Column, message: Column) -> Column:
    """struct of the status of a case whose evidence cannot be read; it overrides every flag."""
    said = F.coalesce(_present(message), _table(MANIFEST_MESSAGES, code), F.lit("Judgment data error: evidence could not be validated."))
    off = F.lit(False)
    return F.struct(
        F.lit("data_state_error").alias("case_status"), F.lit("Judgment data error").alias("status_label"), said.alias("status_detail"),
        F.coalesce(_present(code), F.lit("judgment_data_error")).alias("error_code"), off.alias("has_final_disposition"), off.alias("judgment_entered"), off.alias("satisfied"),
    )


def described(summaries: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Descriptions of outcomes, one row a summary.

    events: key, pos, hash, status, event_kind, entry_date, outcome_components,
    review_reasons.  summaries: key and the columns read below; hashes point to
    events, in the order current_hash, selected_hash.  The operative event, else
    the first one, stands in where no hash does.
    """
    fields = ("hash", "status", "event_kind", "entry_date", "outcome_components")
    named = events.withColumn("e", F.struct(*fields)).withColumn("operative", F.coalesce(F.col("status").isin("operative", "superseding"), F.lit(False)))
    of = named.join(summaries.select(key, "current_hash", "selected_hash", "final_hash"), key)
    place = lambda *ranks: F.coalesce(*[F.when(cond, i) for i, cond in enumerate(ranks)])
    hit = lambda c: F.col("hash") == F.col(c)
    now = place(hit("current_hash"), hit("selected_hash"), F.col("operative"), F.lit(True))
    last = place(hit("final_hash"), hit("selected_hash"))
    by = of.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("operative").alias("operative"), F.min_by("e", F.struct(now, "pos")).alias("cur"),
        F.min_by("e", F.when(last.isNotNull(), F.struct(last, F.col("pos")))).alias("fin"),
    )
    # a case's reasons are few, its events need not be
    reasons = events.select(key, F.explode("review_reasons").alias("reason")).distinct().groupBy(key).agg(F.collect_list("reason").alias("event_reasons"))
    s = summaries.join(by, key, "left").join(reasons, key, "left")
    has = lambda c: _trim(F.col(c)) != ""
    judged = has("current_hash") | has("actual_kind") | F.col("amount").isNotNull() | (F.coalesce("final_count", F.lit(0)) > 0) | F.coalesce("operative", F.lit(False))
    s = s.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("reference", (F.col("n") > 0) & ~judged).withColumn("fin", F.coalesce("fin", "cur"))
    kind = F.when(F.col("reference"), "judgment_reference").otherwise(F.coalesce(_present(F.col("actual_kind")), _present(F.col("cur.event_kind")), F.lit("judgment")))
    s = s.withColumn("kind", kind)
    final = F.when(F.col("reference"), "judgment_reference").otherwise(F.coalesce(_present(F.col("final_kind")), _present(F.col("fin.event_kind")), F.col("kind")))
    s = s.withColumn("ended", final)
    final_day, day = F.coalesce(_present(F.col("final_date")), _present(F.col("fin.entry_date")), F.lit("")), _trim(F.col("cur.entry_date"))
    on = lambda d: F.when(d != "", F.concat(F.lit(" on "), d)).otherwise("")
    label, operative = observed_label(F.col("ended"), components(F.col("final_components"), F.col("fin.outcome_components"))), event_label(F.col("kind"))
    tracks = F.array_join(F.filter(F.transform(components(F.col("domains")), domain_label), lambda x: x != ""), "; ")
    nature = F.when(F.col("reference"), "no operative judgment was extracted; reference and rejected judgment source rows are retained for review.").otherwise(F.concat_ws(
        " ", F.concat(F.lit("Final disposition: "), label, on(final_day), F.lit(".")),
        F.when(operative != label, F.concat(F.lit("Operative judgment: "), operative, on(F.when(day != final_day, day).otherwise("")), F.lit("."))),
        F.when(tracks != "", F.concat(F.lit("Tracks: "), tracks, F.lit("."))),
    ))
    nothing = (F.col("kind") == "take_nothing") | (F.col("ended") == "take_nothing") | F.array_contains(components(F.col("domains")), "take_nothing")
    money = (
        F.when(nothing, "Final amount: take nothing.").when(F.col("amount").isNotNull(), F.concat(F.lit("Final amount: "), text.amount_text(F.col("amount")), F.lit(" recorded in the judgment/renewal source.")))
        .otherwise("Final amount: not stated in extracted judgment rows.")
    )
    many = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    groups, finals = F.coalesce("group_count", F.lit(0)), F.coalesce("final_count", F.lit(0))
    source = F.concat(F.concat_ws("; ", many(F.col("n"), "judgment/end-state source event"), many(groups, "disposition track"), many(finals, "final event")), F.lit("."))
    reasons = F.transform(review_reasons(F.col("conflict_reasons"), F.col("event_reasons")), words)
    empty = (F.col("n") == 0) & F.col("bare")
    pick = lambda e, x: F.when(empty, e).otherwise(x)
    satisfied = satisfaction(F.col("satisfied"), F.col("satisfaction_state"), F.col("satisfaction_label"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return s.select(
        key, pick("No extracted judgment/end-state events are recorded for this case.", nature).alias("nature"), pick("Final amount: not stated.", money).alias("amount_description"),
        pick("not applicable", satisfied).alias("satisfaction"), pick("No judgment source rows were found in the generated judgment shard.", source).alias("source_description"),
        pick("no review flags", F.when(F.size(reasons) > 0, F.concat(F.lit("review required: "), F.array_join(reasons, "; "))).otherwise("no review flags")).alias("review"),
    )


_EVENT = (
    "entry_hash string, source_row_hash string, source_evidence_hash string, status string, event_kind string, entry_date string, disposition_domain string, disposition_domains array<string>,"
    " outcome_components array<string>, current_effect string, finality string, disposition_scope string, is_final_disposition boolean, case_closure_effect string, source_text string"
)
_SUMMARY = (
    "latest_dispositive_event_hash string, selected_event_hash string, current_judgment_event_hash string, actual_judgment_event_hash string, latest_dispositive_event_kind string, selected_event_kind string,"
    " latest_dispositive_event_date string, latest_dispositive_outcome_components array<string>, disposition_domains array<string>, case_model string, case_closure_status string, case_closure_effect string,"
    " case_closure_basis string, case_closure_event_hash string, judgment_is_vacated boolean, judgment_is_satisfied boolean,"
    " disposition_groups array<struct<current_effect:string, current_state:string, is_current_final:boolean, is_final:boolean>>"
)
_RECORD = (
    f"struct<summary:struct<{_SUMMARY.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>,"
    f" operative_summary:struct<{_SUMMARY.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>,"
    f" events:array<struct<{_EVENT.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>,"
    " case_model:string, case_closure_status:string, case_closure_effect:string, case_closure_basis:string, rule_id:string, rule_version:string>"
)
_UNDONE = ("vacated", "superseded", "reversed", "set_aside")
_HASHES = ("latest_dispositive_event_hash", "selected_event_hash", "current_judgment_event_hash", "actual_judgment_event_hash")


def projection(records: DataFrame, key: str, record: str, no_data: Column | None = None, explicit_open: Column | None = None, status_label: Column | None = None) -> DataFrame:
    """The status of a case as its outcome record (JSON text) says it, one row a record.

    The current event is the first one that a hash of the summary names, else the last
    operative one.  A case is terminated only if its summary says so and names an event
    that closes it; other dispositions are evidence.  Everything is read off the record's own
    row.  `no_data`, `explicit_open` and `status_label` are what is known of the case without the record.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_data, explicit_open = yes(F.lit(False) if no_data is None else no_data), yes(F.lit(False) if explicit_open is None else explicit_open)
    told = F.lit(None).cast("string") if status_label is None else status_label
    x = records.withColumn("_r", F.from_json(record, _RECORD))
    events = F.coalesce(F.col("_r.events"), F.array().cast(x.select("_r.events").schema[0].dataType))
    x = x.withColumn("_events", F.filter(events, lambda e: e.isNotNull())).withColumn("_s", F.coalesce(F.col("_r.summary"), F.col("_r.operative_summary")))
    s = lambda name: F.col(f"_s.{name}")
    either = lambda name: F.coalesce(_present(s(name)), _present(F.col(f"_r.{name}")), F.lit(""))

    def named(h: Column) -> Column:
        hit = lambda e: yes(e["entry_hash"] == h) | yes(e["source_row_hash"] == h) | yes(e["source_evidence_hash"] == h)
        return F.when(F.coalesce(h, F.lit("")) != "", F.get(F.filter("_events", hit), F.lit(0)))

    operative = F.filter("_events", lambda e: yes(e["status"].isin("operative", "superseding")))
    x = x.withColumn("_operative", operative).withColumn("_groups", F.filter(F.coalesce(s("disposition_groups"), F.array().cast(x.select("_s.disposition_groups").schema[0].dataType)), lambda g: g.isNotNull()))
    x = x.withColumn("_current", F.coalesce(*[named(s(h)) for h in _HASHES], F.try_element_at("_operative", F.lit(-1)))).withColumn("_closing", named(F.nullif(_trim(s("case_closure_event_hash")), F.lit(""))))
    now, last = (lambda f: F.col(f"_current.{f}")), (lambda f: F.col(f"_closing.{f}"))
    of_events = F.array_distinct(F.flatten(F.transform("_operative", lambda e: F.coalesce(e["disposition_domains"], F.array(e["disposition_domain"])))))
    x = x.withColumn("_domains", F.filter(F.coalesce(s("disposition_domains"), of_events), lambda d: F.coalesce(d, F.lit("")) != ""))
    valid = yes(valid_closure(last("status"), last("current_effect"), last("disposition_scope"), last("finality"), last("is_final_disposition"), last("case_closure_effect"), last("event_kind"), s("case_closure_basis")))
    state = lambda g: state_name(F.coalesce(g["current_effect"], g["current_state"]))
    undone = yes(s("judgment_is_vacated")) | F.exists("_groups", lambda g: state(g).isin("vacated", "set_aside"))
    x = x.withColumns({
        "status": either("case_closure_status"), "effect": either("case_closure_effect"), "basis": either("case_closure_basis"), "valid": valid, "vacated": undone,
        "evidence": (F.size("_operative") > 0) | (F.size("_groups") > 0), "satisfied": yes(s("judgment_is_satisfied")),
        "kind": F.coalesce(_present(now("event_kind")), _present(s("latest_dispositive_event_kind")), _present(s("selected_event_kind")), F.lit("")),
        "day": F.coalesce(_present(now("entry_date")), _present(s("latest_dispositive_event_date")), F.lit("")), "domain": _trim(now("disposition_domain")),
        "parts": components(now("outcome_components"), s("latest_dispositive_outcome_components")),
    })
    ended = state_name(F.col("status")).isin("terminated", "closed", "whole_case_terminated") & (state_name(F.col("effect")) == "closes_case") & F.col("valid") & ~F.col("vacated")
    x = x.withColumn("ended", ended).withColumn("open", state_name(F.col("status")).isin("open", "active", "pending", "affirmatively_open") | explicit_open)
    x = x.withColumn("result", result_label(F.col("kind"), F.col("domain"), F.col("_domains"), F.col("parts"), F.col("ended")))
    group_final = F.exists("_groups", lambda g: yes(g["is_current_final"]) | (g["is_current_final"].isNull() & yes(g["is_final"]) & ~state(g).isin(*_UNDONE)))
    event_final = F.exists("_operative", lambda e: yes(e["is_final_disposition"]) & ~state_name(e["current_effect"]).isin(*_UNDONE) & ~yes(e["event_kind"].isin("vacatur", "renewal", "satisfaction", "partial_satisfaction")))
    on = F.when(F.col("day") != "", F.concat(F.lit(" on "), F.col("day"))).otherwise("")
    because = F.when(F.col("basis") != "", F.concat(F.lit(" ("), words(F.col("basis")), F.lit(")"))).otherwise("")
    case_status = (
        F.when(no_data, "unavailable").when(F.col("satisfied"), "judgment_satisfied").when(F.col("ended"), "case_terminated").when(F.col("vacated") & F.col("evidence"), "disposition_vacated")
        .when(F.col("evidence"), "disposition_evidence").when(F.col("open"), "affirmatively_open").otherwise("unknown")
    )
    said = _present(told)
    label = (
        F.when(no_data, F.coalesce(said, F.lit("No data"))).when(F.col("satisfied"), "Satisfaction of judgment on file").when(F.col("ended"), F.col("result"))
        .when(F.col("vacated") & F.col("evidence"), "Prior disposition vacated or set aside").when(F.col("evidence"), F.col("result"))
        .when(F.col("open"), F.coalesce(said, F.concat(F.lit("Court status: "), words(F.col("status"))))).otherwise("Unknown / no final disposition detected")
    )
    finality = (
        F.when(no_data, "No data").when(F.col("ended"), F.concat(F.col("result"), on, because))
        .when(F.col("evidence"), F.concat(F.col("result"), on, F.lit("; closure of the entire case not established"))).otherwise("Unknown / no final disposition detected")
    )
    judged = (F.coalesce(s("current_judgment_event_hash"), F.lit("")) != "") | (F.coalesce(s("actual_judgment_event_hash"), F.lit("")) != "")
    return x.select(
        key, case_status.alias("case_status"), label.alias("status_label"), finality.alias("finality_label"), F.col("evidence").alias("has_disposition_evidence"),
        (~F.col("vacated") & (group_final | event_final)).alias("has_current_final_disposition"), F.col("ended").alias("whole_case_terminated"), F.col("open").alias("affirmatively_open"),
        F.coalesce(_present(F.col("kind")), F.col("domain")).alias("final_disposition_type"), F.col("day").alias("final_disposition_date"), (judged & ~F.col("vacated")).alias("judgment_entered"),
        F.col("vacated").alias("judgment_is_vacated"), "satisfied", F.col("_domains").alias("disposition_domains"), F.col("parts").alias("outcome_components"),
        F.coalesce(_present(now("entry_hash")), _present(s("latest_dispositive_event_hash")), F.lit("")).alias("current_event_hash"), F.col("kind").alias("current_event_kind"),
        F.coalesce(_present(F.col("status")), F.lit("unknown")).alias("case_closure_status"), F.coalesce(_present(F.col("effect")), F.when(F.col("ended"), "closes_case").otherwise("unknown")).alias("case_closure_effect"),
        F.col("basis").alias("case_closure_basis"), F.col("valid").alias("case_closure_evidence_valid"), F.coalesce(_present(s("case_model")), _present(F.col("_r.case_model")), F.lit("unknown")).alias("status_domain"),
        _trim(F.col("_r.rule_id")).alias("outcome_rule_id"), _trim(now("source_text")).alias("status_detail"),
    )
