"""Facts of a case from its JSON: parts by alias, filing date, documents, notices, outcomes in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.fixed import (
    ANONYMOUS_OFFICER,
    DEFERRAL_REASONS,
    MANIFEST_MESSAGES,
    NAME_ARTEFACT,
    NO_DETAIL,
    NOT_A_FILING,
    NOTICE_RULES,
    NOTICES,
    OPEN_STATUSES,
    PETITION_NUMBER,
    PLEADING_KINDS,
    PRO_TEM_LEAD,
    PRO_TEM_TAIL,
)
from .records import amendment, state_name

# Names under which a field of a part may stand, in order.
ALIASES = {
    "parties": {
        "name": ("name", "party", "NAME", "PARTY"),
        "party_type": ("party_type", "partyType", "type", "PARTYTYPE", "PARTYDESC"),
        "attorneys": ("attorneys", "ATTORNEY(S)"),
    },
    "attorneys": {
        "name": ("name", "NAME", "attorney"),
        "role": ("role", "type", "TYPE", "attorney_type"),
        "bar_number": ("bar_number", "bar", "BARNUM"),
        "address": ("address", "ADDRESS"),
        "represented": ("parties_represented", "party", "PARTY"),
    },
    "docket_entries": {
        "date_filed": ("date_filed", "filedDate", "FILEDATE", "filed", "date"),
        "description": ("description", "docketEntryComment", "RTEXT", "text", "title"),
        "url": ("url", "URL", "source_url", "href"),
        "fee": ("fee", "FEE"),
        "doc_id": ("doc_id", "DocID", "id"),
    },
    "documents": {
        "doc_id": ("doc_id", "DocID", "id"),
        "filed": ("filed", "date_filed", "FILEDATE", "date"),
        "description": ("description", "DESCRIPTION", "title", "name"),
        "url": ("url", "URL", "href", "source_url", "download_url", "pdf_url"),
        "sha256": ("sha256", "sha", "hash"),
    },
    "payments": {
        "date": ("date", "TRANSDATE", "transdate"),
        "amount": ("amount", "AMOUNT"),
        "type": ("type", "PAYTYPETEXT", "pay_type"),
        "receipt": ("receipt", "RECEIPT_NUMBER"),
        "description": ("description", "DESCRIPTION"),
    },
}


def alias_text(v: Column, names: tuple[str, ...]) -> Column:
    """First non-blank text of a variant's fields, each read once."""
    read = F.array(*[F.trim(F.try_variant_get(v, f"$['{n}']", "string")) for n in names])
    return F.coalesce(F.get(F.filter(read, lambda x: x != ""), F.lit(0)), F.lit(""))


def part(records: DataFrame, key: str, record: str, name: str) -> DataFrame:
    """Rows of one part of the records (JSON text): key, idx and the part's fields; blank rows go."""
    v = F.try_variant_get(F.try_parse_json(F.col(record)), f"$.{name}", "array<variant>")
    rows = records.select(key, F.posexplode(v).alias("idx", "v"))
    fields = {n: alias_text(F.col("v"), names) for n, names in ALIASES[name].items()}
    out = rows.select(key, "idx", *[c.alias(n) for n, c in fields.items()])
    return out.where(text.any_of([F.col(n) != "" for n in fields]))


def first_filing_date(records: DataFrame, key: str, direct: str, docket: DataFrame, documents: DataFrame) -> DataFrame:
    """The record's own date, else its first complaint or petition, dated docket row, or dated document."""
    d = docket.where("date_filed <> ''")
    complaint = F.col("description").rlike(r"(?i)\b(?:complaint|petition)\b")
    anchor = d.groupBy(key).agg(F.min_by("date_filed", F.struct(F.when(complaint, 0).otherwise(1), F.col("idx"))).alias("a"))
    doc = documents.where("filed <> ''").groupBy(key).agg(F.min_by("filed", "idx").alias("b"))
    out = records.select(key, direct).join(anchor, key, "left").join(doc, key, "left")
    raw = text.first_text(F.col(direct), F.col("a"), F.col("b"))
    return out.select(key, F.coalesce(F.nullif(dates.find_iso(raw), F.lit("")), F.substring(raw, 1, 10)).alias("filed"))


def has_archived_bytes(direct: list[Column], tag: Column, asset: Column) -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return text.any_of([~blank(c) for c in direct]) | (~blank(tag) & ~blank(asset))


def complete_deferral(deferred: Column, reason: Column, error: Column) -> Column:
    known = F.trim(F.coalesce(reason, F.lit(""))).isin("", *DEFERRAL_REASONS)
    return F.coalesce(deferred, F.lit(False)) & known & (F.trim(F.coalesce(error, F.lit(""))) == "")


def is_pleading(description: Column, kind: str) -> Column:
    """The filing of a pleading of `kind`; only the head before court metadata may not speak of something else."""
    head = F.split(description, r"(?i)\b(?:TRANSACTION ID|FILED BY)\b", 2)[0]
    head = F.regexp_replace(head, r"(?i)\*+\s*PER\b.{0,80}?\bORDER\s*\*+", " ")
    return F.coalesce(description.rlike(rf"(?i){kind}") & ~head.rlike(NOT_A_FILING), F.lit(False))


def facet_officer(x: Column) -> Column:
    """Label of an officer who is a person, else null."""
    label = text.clean(x)
    bare = F.when(label.rlike(PRO_TEM_LEAD), F.regexp_replace(label, PRO_TEM_LEAD, "")).when(label.rlike(PRO_TEM_TAIL), F.regexp_replace(label, PRO_TEM_TAIL, "")).otherwise(label)
    name = text.person_label(bare)
    known = (name != "") & ~bare.rlike(ANONYMOUS_OFFICER) & ~name.rlike(ANONYMOUS_OFFICER)
    words = F.exists(F.split(text.officer_key(name), " "), lambda w: (F.length(w) > 1) & w.rlike("[a-z]"))
    return F.when(known & words, name)


def open_status(*fields: Column) -> Column:
    """First field that says the case is open, else ''."""
    ok = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[_\s-]+", " ").isin(*OPEN_STATUSES)
    return F.coalesce(*[F.when(ok(c), F.trim(c)) for c in fields], F.lit(""))


def notice_rule(x: Column) -> Column:
    """The rule that an unavailability notice cites, else other or none."""
    t = F.trim(F.coalesce(x, F.lit("")))
    out = F.when(F.lit(False), "")
    for (pattern, _, _), rule in zip(NOTICES, NOTICE_RULES):
        out = out.when(t.rlike(pattern), rule)
    return out.otherwise("other")


def notice(x: Column) -> Column:
    """struct(title, subtitle) of an unavailability notice; one that is not known stands as it is."""
    t = F.trim(F.coalesce(x, F.lit("")))
    title, subtitle = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for pattern, head, below in NOTICES:
        title, subtitle = title.when(t.rlike(pattern), head), subtitle.when(t.rlike(pattern), below)
    return F.struct(title.otherwise(t).alias("title"), subtitle.otherwise(NO_DETAIL).alias("subtitle"))


def valid_closure(status: Column, effect: Column, scope: Column, finality: Column, final: Column, closes: Column, kind: Column, basis: Column) -> Column:
    """An operative, terminal, final event of the whole case that closes it (or the one-petition exception)."""
    single = (state_name(kind) == "name_change_decree") & (F.trim(F.coalesce(basis, F.lit(""))) == "observed_single_petition:name_change_decree")
    return (
        state_name(status).isin("operative", "superseding") & (state_name(effect) == "operative") & ((state_name(scope) == "case") | single)
        & (state_name(finality) == "terminal") & F.coalesce(final, F.lit(False)) & (state_name(closes) == "closes_case")
    )


def current_final(groups_final: Column, event_final: Column, effect: Column, kind: Column) -> Column:
    """A current final group, or a final event that still stands and is a disposition."""
    stands = ~state_name(effect).isin("vacated", "superseded", "reversed", "set_aside")
    return F.coalesce(groups_final, F.lit(False)) | (F.coalesce(event_final, F.lit(False)) & stands & ~kind.isin("vacatur", "renewal", "satisfaction", "partial_satisfaction"))


def satisfaction(satisfied: Column, state: Column, explicit: Column, amount: Column, basis: Column, percent: Column) -> Column:
    """full > unsatisfied > explicit words > computed share > amount > none."""
    said, s = F.trim(F.coalesce(explicit, F.lit(""))), F.lower(F.trim(F.coalesce(state, F.lit(""))))
    none = F.lit("No current full satisfaction recorded")
    pct = F.when(percent <= 1, percent * 100).otherwise(percent)
    whole = F.abs(pct - F.round(pct)) < 0.05
    shown = F.when(percent.isNull(), "partially").when(whole, F.concat(F.round(pct).cast("long").cast("string"), F.lit("%"))).otherwise(F.concat(F.format_number(pct, 1), F.lit("%")))
    return (
        F.when(F.coalesce(satisfied, F.lit(False)) | (s == "completely_satisfied") | said.rlike(r"(?i)^(?:completely\s+)?satisfied$"), "Satisfaction of judgment on file")
        .when((s == "unsatisfied") | (F.lower(said) == "unsatisfied"), none)
        .when(said != "", said)
        .when(amount.isNotNull() & basis.isNotNull(), F.concat(shown, F.lit(" satisfied ("), text.money_text(amount), F.lit("/"), text.money_text(basis), F.lit(")")))
        .when(amount.isNotNull(), F.concat(F.lit("partially satisfied ("), text.money_text(amount), F.lit(" recorded)")))
        .otherwise(none)
    )


def manifest_message(code: str, schema="missing") -> str:
    """What a reader is told of manifest_error()."""
    other = f"Judgment data error: manifest schema {schema} is incompatible with this viewer."
    return MANIFEST_MESSAGES.get(code, other) if code else ""


def manifest_error(m: dict, schemas=(1, 2, 4), pattern: str | None = None, rule: str | None = None, algorithm: str | None = None) -> str:
    """'' or the first thing wrong with a manifest."""
    import re

    if not isinstance(m, dict):
        return "manifest_invalid"
    if m.get("schema_version") not in schemas:
        return "manifest_schema_incompatible"
    if (pattern is not None and m.get("shard_pattern") != pattern) or (algorithm is not None and m.get("hash_algorithm") != algorithm):
        return "manifest_layout_incompatible"
    if rule is not None and m.get("rule_id") != rule:
        return "manifest_rule_incompatible"
    if not re.fullmatch(r"\d+\.\d+\.\d+\S*", str(m.get("rule_version", "0.0.0"))):
        return "manifest_rule_version_invalid"
    if not re.fullmatch(r"[0-9a-f]{40}", str(m.get("source_snapshot_id", "0" * 40))):
        return "manifest_source_snapshot_invalid"
    return ""


def shard_key(explicit: Column, reference: Column) -> Column:
    """The shard that two references name; they may not disagree and must have the right form."""
    a = F.nullif(F.trim(F.coalesce(explicit, F.lit(""))), F.lit(""))
    r = F.trim(F.coalesce(reference, F.lit("")))
    b = F.when(r.startswith("release-shard:"), F.substring(r, 15, 1 << 20))
    key = F.coalesce(a, b)
    bad = F.concat(F.lit("bad shard reference "), F.coalesce(key, F.lit("")))
    wrong = (a.isNotNull() & b.isNotNull() & (a != b)) | ~key.rlike(r"^[^/\s]+/[0-9a-f]{2}$")
    return F.when(key.isNull(), "").when(wrong, F.raise_error(bad)).otherwise(key)


def first_allowed(urls: list[Column], allowed: str) -> Column:
    """First URL that matches the allow-list pattern, else null."""
    return F.coalesce(*[F.when(F.trim(u).rlike(allowed), F.trim(u)) for u in urls])


def discovery_text(cases: Column, discovered: Column, restricted: Column, missing: Column) -> Column:
    plus = lambda c, word: F.when(c > 0, F.concat(F.lit(" + "), F.format_number(c, 0), F.lit(f" {word}"))).otherwise("")
    return F.concat(F.format_number(cases, 0), F.when(cases == 1, " docket").otherwise(" dockets"), plus(restricted, "restricted"), plus(missing, "no-match"), plus(discovered, "discovered"))


def counts_by_alias(owners: DataFrame, owner: str, spellings: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum of counts per owner over the spellings that only it has; 0 where none.

    spellings: (owner, spelling); counts: (spelling, n), invalid n skipped.
    """
    only = spellings.groupBy("spelling").agg(F.count_distinct("owner").alias("k"), F.min("owner").alias(owner)).where("k = 1").drop("k")
    total = counts.where("n >= 0").join(only, "spelling").groupBy(owner).agg(F.sum("n").alias("total"))
    return owners.join(total, owner, "left").select(*owners.columns, F.coalesce("total", F.lit(0)).alias("total"))


def relocate(old: DataFrame, new: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes to (path, idx) rewritten to the record's new place; routes to nothing go."""
    place = old.join(new.withColumnRenamed("path", "new_path").withColumnRenamed("idx", "new_idx"), "record_id")
    return routes.join(place, ["path", "idx"]).select("route", F.col("new_path").alias("path"), F.col("new_idx").alias("idx"))


def by_priority(rows: DataFrame, key: str, first: tuple[DataFrame, str], second: tuple[DataFrame, str], value: str) -> DataFrame:
    """`value` by the first table's key, else by the second's."""
    (a, ka), (b, kb) = first, second
    x = rows.join(a.select(F.col(ka), F.col(value).alias("_a")).dropDuplicates([ka]), ka, "left")
    x = x.join(b.select(F.col(kb), F.col(value).alias("_b")).dropDuplicates([kb]), kb, "left")
    return x.select(key, F.coalesce("_a", "_b").alias(value))


def count_mismatches(entities: DataFrame, key: str, count: str, categories: DataFrame) -> DataFrame:
    """Entities whose category counts do not add up to a positive count."""
    total = categories.groupBy(key).agg(F.sum("n").alias("t"))
    return entities.join(total, key, "left").where((F.col(count) <= 0) | ~F.col(count).eqNullSafe(F.col("t"))).select(key, count, F.coalesce("t", F.lit(0)).alias("t"))


def disposition_label(kind: Column, domain: Column, components: Column, overrides: dict[str, str] | None = None) -> Column:
    """Words for an outcome: dismissed, a reviewed label of its kind, the kind or the domain in words."""
    k, d = state_name(kind), state_name(domain)
    words = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.replace(c.substr(F.lit(2), F.length(c)), F.lit("_"), F.lit(" ")))
    out = F.when(F.coalesce(F.array_contains(components, "dismissed"), F.lit(False)) | (k == "dismissal"), "Dismissed")
    for name, label in (overrides or {}).items():
        out = out.when(k == name, label)
    return out.when(k != "", words(k)).when(d != "", F.concat(words(d), F.lit(" disposition"))).otherwise("Disposition recorded")


def review_reasons(*lists: Column) -> Column:
    """Distinct reasons of all lists, sorted."""
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    return F.array_sort(F.array_distinct(F.filter(every, lambda r: F.trim(r) != "")))


def roster_rule(source: Column) -> Column:
    """solid from the roster, tentative from the docket, invalid from elsewhere."""
    return F.when(source == "judicial_council", "solid").when(source == "docket", "tentative").otherwise("invalid")


def visible_entities(kind: Column, matters: Column) -> Column:
    """Judges always; others with matters."""
    return (kind == "judge") | (F.coalesce(matters, F.lit(0)) > 0)


def representation(mode: str, represented: Column, alone: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0))
    return {"both": n(represented) + n(alone), "represented": n(represented), "pro_per": n(alone)}[mode] > 0


def is_artefact(name: Column) -> Column:
    """An office or a form in the place of an attorney's name."""
    return F.coalesce(name.rlike(NAME_ARTEFACT), F.lit(False))


def is_fictitious(name: Column) -> Column:
    """'Does 1 through N' and the like."""
    return F.coalesce(name.rlike(r"(?i)^\s*(?:does?|roes?)\s+\d+\s*(?:-|to|through|thru)\s*\d+"), F.lit(False))


def pleadings(documents: DataFrame, key: str) -> DataFrame:
    """`documents` (key, doc_id, description, filed, sha256, pos) that file a pleading, with kind, amendment and place.

    A cross-complaint is no complaint; accounting petitions are left out.  Place 1
    of a kind is the operative one: highest amendment, then latest, then first listed.
    """
    d = F.coalesce(F.col("description"), F.lit(""))
    cross = d.rlike(f"(?i){PLEADING_KINDS['cross']}")
    kind = (
        F.when(cross & is_pleading(d, PLEADING_KINDS["cross"]), "cross")
        .when(~cross & is_pleading(d, PLEADING_KINDS["complaint"]), "complaint")
        .when(~cross & is_pleading(d, PLEADING_KINDS["petition"]) & ~F.upper(d).rlike(r"\bACCOUNTING PETITION\b"), "petition")
    )
    rows = documents.withColumn("kind", kind).where("kind is not null").withColumn("amendment", amendment(F.col("description")))
    w = Window.partitionBy(key, "kind").orderBy(F.col("amendment").desc(), F.coalesce("filed", F.lit("")).desc(), "pos")
    return rows.withColumn("place", F.row_number().over(w))


def causes_of_action(cases: DataFrame, key: str, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Causes of every case (key, case_number, cause_of_action) from its pleadings' texts (sha256, text).

    The operative pleading with causes counts if it is amended, else the one with
    most causes; without causes in a text the description speaks.  Columns: key,
    kind, filed, petition_for, complaint, cross_complaint, source, available, note.
    """
    from .captions import fallback_causes, parse_causes, petition_for

    p = pleadings(documents, key)
    parsed = p.select("sha256").where("sha256 is not null").distinct().join(texts, "sha256").withColumn("causes", parse_causes(F.col("text")))
    p = p.join(parsed.select("sha256", "causes"), "sha256", "left").withColumn("n", F.coalesce(F.size("causes"), F.lit(0)))
    # an amended pleading with a cause ends the search; up to it the longest list wins, the earlier place among equals
    last = F.min(F.when((F.col("n") > 0) & (F.col("amendment") > 0), F.col("place"))).over(Window.partitionBy(key, "kind"))
    tried = p.withColumn("last", last).withColumn("tried", F.col("last").isNull() | (F.col("place") <= F.col("last")))
    best = F.max_by(F.when(F.col("tried"), F.col("causes")), F.when(F.col("tried"), F.struct(F.col("n"), -F.col("place"))))
    by = tried.groupBy(key, "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count("sha256").alias("captured"), F.count("causes").alias("read"), best.alias("causes"),
        F.min_by(F.struct("filed", "description"), "place").alias("first"),
    )
    of = lambda k: by.where(F.col("kind") == k).select(key, F.struct("rows", "captured", "read", "causes", "first").alias(k))
    c = cases
    for k in PLEADING_KINDS:
        c = c.join(of(k), key, "left")
    petition = F.upper(F.coalesce("case_number", F.lit(""))).rlike(PETITION_NUMBER) | (F.col("petition").isNotNull() & F.col("complaint").isNull())
    c = c.withColumn("is_petition", petition).withColumn("main", F.when(F.col("is_petition") & F.col("petition").isNotNull(), F.col("petition")).otherwise(F.col("complaint")))
    none = F.array().cast("array<struct<n:int,label:string,statute:string>>")
    number = lambda f: F.coalesce(F.col(f"main.{f}"), F.lit(0)) + F.coalesce(F.col(f"cross.{f}"), F.lit(0))
    own, other = F.coalesce("main.causes", none), F.coalesce("cross.causes", none)
    about = F.when(F.col("is_petition") & F.col("main").isNotNull(), petition_for(F.col("main.first.description")))
    coa = F.coalesce("cause_of_action", F.lit(""))
    named = lambda x, end: F.regexp_extract(x, rf"(?i)complaint\s+for\s+([^{end}]+)", 1)
    said = F.when(named(coa, ")") != "", named(coa, ")")).otherwise(F.regexp_replace(coa, r"\(.*?\)", ""))
    c = c.withColumns({"own": own, "other": other, "rows": number("rows"), "captured": number("captured"), "read": number("read"), "petition_for": about})
    c = c.withColumns({"by_case": fallback_causes(said), "by_text": fallback_causes(named(F.coalesce("main.first.description", F.lit("")), ",("))})
    described = F.when(F.size("by_case") > 0, F.col("by_case")).otherwise(F.col("by_text"))
    asked = F.when(F.col("petition_for").isNotNull(), F.array(F.struct(F.lit(1).alias("n"), F.col("petition_for").alias("label"), F.lit(None).cast("string").alias("statute")))).otherwise(none)
    c = c.withColumn("fallback", F.when(F.col("is_petition"), asked).otherwise(described))
    found, some = (F.size("own") > 0) | (F.size("other") > 0), F.size("fallback") > 0
    unread = (F.col("captured") > 0) & (F.col("read") == 0)
    use = ~found & some & ~unread & (F.col("rows") > 0)
    word = F.when(F.col("is_petition"), "petition").otherwise("complaint")
    note = (
        F.when(found, F.lit(None).cast("string"))
        .when(F.col("read") > 0, F.when(some, "no enumerated cause list found in OCR caption; using document description").otherwise("complaint captured but no cause list parsed"))
        .when(unread, F.concat(word, F.lit(" OCR not available")))
        .when((F.col("rows") > 0) & some, "complaint document not captured; causes inferred from docket description")
        .when(F.col("rows") > 0, F.concat(word, F.lit(" document not captured")))
        .otherwise(F.concat(F.lit("no "), word, F.lit(" document found")))
    )
    return c.select(
        key, word.alias("kind"), F.col("main.first.filed").alias("filed"), "petition_for", F.when(use, F.col("fallback")).otherwise(F.col("own")).alias("complaint"),
        F.col("other").alias("cross_complaint"), F.when(found, "ocr").when(use, "description").otherwise("none").alias("source"), (found | (F.col("read") > 0)).alias("available"), note.alias("note"),
    )


def choose_pleading(candidates: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """(key, doc_id, sha256, source, causes): the candidate with most parsed causes, earlier rank first.

    candidates: key, doc_id, sha256, rank; texts: sha256, text.
    """
    from .captions import parse_causes

    j = candidates.join(texts, "sha256", "left").withColumn("causes", parse_causes(F.col("text")))
    n = F.size(F.coalesce("causes", F.array().cast(j.schema["causes"].dataType)))
    best = j.groupBy(key).agg(F.min_by(F.struct("doc_id", "sha256", F.col("text").isNotNull().alias("has_text"), "causes"), F.struct(-n, F.col("rank"), F.col("doc_id"))).alias("b"))
    source = F.when(F.size("b.causes") > 0, "pleading").when(F.col("b.has_text"), "no_causes_found").otherwise("text_unavailable")
    return best.select(key, "b.doc_id", "b.sha256", source.alias("source"), "b.causes")
