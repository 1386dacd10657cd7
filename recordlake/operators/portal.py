"""Records of a criminal portal remapped to cases, and the assembled facts of any case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.fixed import GENERIC_CRIMINAL_TITLE, MACHINE_REASON, NOT_PUBLIC, UNRESOLVED_TITLE
from . import casefacts
from .captions import clean_attorneys
from .casefacts import alias_text


@dataclass(frozen=True)
class Portal:
    """Names and addresses of a portal; its records carry the schema or the source."""

    schema: str = "criminal-portal-case-v1"
    source: str = "criminal-portal"
    url: str = "https://portal.example/criminal"
    civil_url: str = "https://portal.example/case?number="
    court: str = "Superior Court - Criminal"


def field(v: Column, *path: str) -> Column:
    """Text of a variant's field, trimmed; '' where there is none."""
    return F.trim(F.coalesce(F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "string"), F.lit("")))


def _present(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def is_portal(v: Column, p: Portal = Portal()) -> Column:
    """Whether a record is of the criminal portal."""
    number = field(v, "case_number")
    return (
        (F.lower(field(v, "schema")) == p.schema) | (F.lower(field(v, "source")) == p.source) | (F.lower(field(v, "case_type")) == "criminal")
        | number.rlike(r"(?i)^CRI[-_\s]*\d{6,}$") | (field(v, "criminal_case_number") != "")
    )


def without_reason(x: Column) -> Column:
    """Text without the machine's reason."""
    s = F.regexp_replace(text.clean_inline(x), MACHINE_REASON, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+([.,;:])", "$1"), r"\s{2,}", " "))


def is_generic_title(x: Column) -> Column:
    t = text.clean_inline(x)
    return (t != "") & t.rlike(f"(?i){GENERIC_CRIMINAL_TITLE.removeprefix('(?i)')}")


def is_weak_title(x: Column) -> Column:
    return is_generic_title(x) | text.clean_inline(x).rlike(UNRESOLVED_TITLE)


def identity_title(raw: Column, number: Column, unavailable: Column) -> Column:
    """The title of a case whose defendant is not known."""
    n, r = text.clean_inline(number), text.clean_inline(raw)
    known = F.coalesce(_present(n), F.when(r != "", F.concat(F.lit("CRI"), r)), F.lit(""))
    known = F.when((known != "") & ~known.rlike("(?i)^CRI"), F.concat(F.lit("CRI"), known)).otherwise(known)
    head = F.concat(F.lit("Criminal identity "), F.when(unavailable, "unavailable").otherwise("unresolved"))
    return F.when(known != "", F.concat(head, F.lit(": "), known)).otherwise(head)


def criminal_title(title: Column, defendant: Column, raw: Column, number: Column, unavailable: Column) -> Column:
    """The title as given, or rebuilt from the defendant or the case number where it says nothing."""
    t = F.trim(F.coalesce(title, F.lit("")))
    weak = (t == "") | is_weak_title(t) | (F.upper(t) == F.upper(defendant))
    nothing = (t == "") | is_generic_title(t)
    return F.when((defendant != "") & weak, F.concat(F.lit("People v. "), defendant)).when(nothing, identity_title(raw, number, unavailable)).otherwise(t)


def redacted(url: Column) -> Column:
    """The URL without its session."""
    return text.without_parameter(F.trim(F.coalesce(url, F.lit(""))), "sessionid")


def portal_url(v: Column, p: Portal = Portal()) -> Column:
    """Explicit URL, the search's redirect, one made of the portal's id, or the portal itself."""
    explicit, redirect = redacted(alias_text(v, ("source_url", "court_url", "url"))), redacted(field(v, "search", "redirect"))
    own = alias_text(v, ("portal_case_id", "portalCaseId"))
    made = F.when(own != "", F.concat(F.lit(f"{p.url}?CaseId="), F.url_encode(own)))
    return F.coalesce(_present(explicit), _present(redirect), made, F.lit(p.url))


def source_url(v: Column, p: Portal = Portal()) -> Column:
    """Explicit URL, a source that is one, the portal's, or the civil one made of the case number."""
    number = F.upper(F.regexp_replace(alias_text(v, ("case_number", "CASE_NUMBER", "caseNum")), "[^A-Za-z0-9]", ""))
    read = F.struct(
        alias_text(v, ("source_url", "case_url", "court_url", "url")).alias("explicit"), field(v, "source").alias("source"), is_portal(v, p).alias("criminal"),
        F.when(is_portal(v, p), portal_url(v, p)).alias("portal"), number.alias("number"),
    )

    def choose(r: Column) -> Column:
        return (
            F.when(r["explicit"] != "", F.when(r["criminal"], redacted(r["explicit"])).otherwise(r["explicit"])).when(r["source"].rlike("(?i)^https?://"), r["source"])
            .when(r["criminal"], r["portal"]).when(r["number"] != "", F.concat(F.lit(p.civil_url), r["number"])).otherwise("")
        )

    return F.transform(F.array(read), choose)[0]  # every part is computed once


def no_information(defendant: Column, filed: Column, charges: Column) -> Column:
    """The sentence that names what little is known."""
    said = lambda head, x: F.when(text.clean_inline(x) != "", F.concat(F.lit(head), text.clean_inline(x)))
    facts = F.array_compact(F.array(said("the name of the defendant, ", defendant), said("date of filing, ", filed), said("charges in the case: ", charges)))
    n = F.size(facts)
    many = F.concat(F.array_join(F.slice(facts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(facts, -1))
    listed = F.when(n == 1, facts[0]).when(n > 1, many)
    return F.coalesce(F.concat(F.lit("No information available besides "), listed, F.lit(".")), F.lit("No information available."))


def unavailable_text(v: Column) -> Column:
    """Why a portal case is not public, or '' for a public one."""
    reason = text.clean_inline(field(v, "unavailable_reason"))
    human = F.when(~reason.rlike("(?i)^[a-z0-9_:-]+$"), reason)
    rows = F.try_variant_get(v, "$.search.rows", "array<variant>")
    row_texts = F.coalesce(F.transform(rows, lambda r: F.to_json(r)), F.array().cast("array<string>"))
    said = F.concat(F.array(field(v, "message"), field(v, "unavailable_text"), F.coalesce(human, F.lit("")), field(v, "search", "message")), row_texts)
    said = F.filter(F.transform(said, text.clean_inline), lambda x: x != "")
    joined = F.array_join(F.filter(F.transform(said, without_reason), lambda x: x != ""), " ")
    closed = F.lower(field(v, "status")).isin("unavailable", "restricted", "not_public", "not_publicly_available") | F.array_join(said, " ").rlike(NOT_PUBLIC)
    return F.when(closed, F.coalesce(_present(joined), F.lit("Criminal portal indicates this case is not publicly available."))).otherwise("")


def start_time(x: Column) -> Column:
    """struct(court_date, hearing_time) of a timestamp in text."""
    t = text.clean_inline(x)
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2}(?=[T\s]|$)|\d{1,2}/\d{1,2}/\d{2,4}(?=\s|$))", 1)
    rest = text.clean_inline(F.regexp_replace(t.substr(F.length(day) + 1, F.length(t)), "^T", ""))
    return F.when(day != "", F.struct(day.alias("court_date"), rest.alias("hearing_time"))).otherwise(F.struct(t.alias("court_date"), F.lit("").alias("hearing_time")))


def docket_rows(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, idx, date_filed, description, submitter) of the register of actions."""
    v = F.try_variant_get(F.try_parse_json(F.col(record)), "$.roa", "array<variant>")
    x = rows.select(key, F.posexplode(v).alias("idx", "v"))
    names = casefacts.ALIASES["docket_entries"]
    return x.select(
        key, "idx", alias_text(F.col("v"), names["date_filed"]).alias("date_filed"), alias_text(F.col("v"), names["description"]).alias("description"),
        alias_text(F.col("v"), ("submitter", "otherSubmitter")).alias("submitter"),
    )


def calendar_entry(v: Column) -> Column:
    """struct(court_date, hearing_time, matters, hearing_type, location, department) of a calendar row."""
    of = lambda *names: alias_text(v, names)
    t = start_time(of("court_date", "startTime", "date", "start_time"))
    return F.struct(
        F.coalesce(_present(of("court_date", "date")), t["court_date"]).alias("court_date"), F.coalesce(_present(of("hearing_time", "time")), t["hearing_time"]).alias("hearing_time"),
        of("matters", "hearingType", "calendar_matter", "description").alias("matters"), of("hearing_type", "hearingType").alias("hearing_type"),
        of("location", "room").alias("location"), of("department", "dept").alias("department"),
    )


def calendar_rows(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, idx, court_date, hearing_time, matters, hearing_type, location, department) of the calendar."""
    v = F.try_variant_get(F.try_parse_json(F.col(record)), "$.calendar", "array<variant>")
    return rows.select(key, F.posexplode(v).alias("idx", "v")).select(key, "idx", calendar_entry(F.col("v")).alias("c")).select(key, "idx", "c.*")


def _flag(v: Column, *names: str) -> Column:
    return text.any_of([F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False)) for n in names for path in (f"$.{n}", f"$.criminal.{n}")])


def _size(v: Column, name: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get(v, f"$.{name}", "array<variant>")), F.lit(0))


def normalize(rows: DataFrame, key: str, record: str, p: Portal = Portal()) -> DataFrame:
    """Header of every portal record (JSON text); other records are left out.

    Identity, title and notice are repaired; parts stay in the record and are
    read by caseparts.assembled, docket_rows, calendar_rows and casefacts.part.
    """
    x = rows.select(F.col(key).alias("_key"), F.try_parse_json(F.col(record)).alias("v")).where(is_portal(F.col("v"), p))
    return with_header(x, p).select(F.col("_key").alias(key), "portal.*")


def with_header(x: DataFrame, p: Portal = Portal()) -> DataFrame:
    """`x`, which has a variant `v`, with the struct `portal` of a portal record's header (null for other records)."""
    v, before = F.col("v"), x.columns
    either = lambda *names: F.coalesce(_present(alias_text(v, names)), _present(alias_text(F.try_variant_get(v, "$.case_header", "variant"), names)), F.lit(""))
    explicit = alias_text(v, ("criminal_case_number", "criminalCaseNumber"))
    x = x.withColumn("criminal", is_portal(v, p))
    own = lambda columns: {n: F.when(F.col("criminal"), c) for n, c in columns.items()}  # noqa: E731  read for portal records only
    x = x.withColumns(own({
        "criminal_case_number": text.criminal_raw_number(explicit, field(v, "case_number")), "case_number": text.criminal_archive_number(explicit, field(v, "case_number")),
        "display_case_number": F.coalesce(_present(field(v, "display_case_number")), field(v, "case_header", "case_number")),
        "defendant": either("defendant"), "filed_date": either("filed_date", "filedDate"),
        "charges": F.coalesce(_present(field(v, "charges")), field(v, "criminal_index", "charges")),
        "identity_unavailable": _flag(v, "identity_unavailable"), "said": unavailable_text(v),
    }))
    unnamed = (F.col("defendant") == "") & (alias_text(v, ("portal_case_id", "portalCaseId")) != "") & ~F.col("identity_unavailable")
    entries = F.greatest(_size(v, "docket_entries"), _size(v, "roa"))
    empty = (entries + _size(v, "calendar") + _size(v, "attorneys") + _size(v, "documents") + _size(v, "payments")) == 0
    texts = F.concat_ws(" ", field(v, "unavailable_reason"), field(v, "unavailable_text"), field(v, "message"), F.col("said"))
    little = ((F.col("said") == "") | texts.rlike(MACHINE_REASON)) & empty & text.any_of([F.col(c) != "" for c in ("defendant", "filed_date", "charges")])
    x = x.withColumns(own({"little": little}))
    shown = without_reason(F.when(F.col("little"), no_information(F.col("defendant"), F.col("filed_date"), F.col("charges"))).otherwise(F.col("said")))
    given = _present(field(v, "unavailable_reason"))
    reason = F.when(F.col("little"), "criminal_portal_no_public_entries").when(F.col("said") != "", F.coalesce(given, F.lit("criminal_portal_not_publicly_available"))).otherwise(F.coalesce(given, F.lit("")))
    title = criminal_title(alias_text(v, ("case_title", "CASETITLE", "title")), F.col("defendant"), F.col("criminal_case_number"), F.col("case_number"), F.col("identity_unavailable"))
    header = F.struct(
        F.lit("criminal").alias("case_type"), "case_number", "criminal_case_number", "display_case_number", "defendant", "filed_date", "charges", title.alias("case_title"),
        "identity_unavailable", (_flag(v, "identity_incomplete") | unnamed).alias("identity_incomplete"), F.coalesce(_present(alias_text(v, ("court", "COURT"))), F.lit(p.court)).alias("court"),
        F.coalesce(_present(alias_text(v, ("cause_of_action", "cause", "CAUSE"))), F.lit("Criminal")).alias("cause_of_action"), portal_url(v, p).alias("source_url"),
        F.when(shown != "", "unavailable").otherwise(field(v, "status")).alias("status"), F.when(shown != "", reason).otherwise(F.coalesce(given, F.lit(""))).alias("unavailable_reason"),
        F.coalesce(_present(shown), _present(field(v, "unavailable_text")), F.lit("")).alias("unavailable_text"),
        (F.coalesce(F.try_variant_get(v, "$.document_bytes_captured", "boolean"), F.lit(False)) | (_size(v, "documents") == 0)).alias("document_bytes_captured"),
        F.coalesce(_present(field(v, "document_byte_capture_scope")), F.lit("criminal-portal-no-documents")).alias("document_byte_capture_scope"),
    )
    return x.select(*before, F.when(F.col("criminal"), header).alias("portal"))


def status_parts(reason: Column, shown: Column, defendant: Column, filed: Column, charges: Column) -> Column:
    """struct(label, detail) of a case that is not public."""
    stub = F.lower(F.trim(reason)) == "sealed_or_unavailable_tentative_stub"
    nothing = F.lower(F.trim(reason)) == "criminal_portal_no_public_entries"
    known = casefacts.notice(shown)
    own = F.coalesce(_present(without_reason(shown)), no_information(defendant, filed, charges))
    return F.struct(
        F.when(stub, "Minimal tentative ruling profile").when(nothing, own).otherwise(known["title"]).alias("label"),
        F.when(stub, "Generated from tentative ruling data; the CaseInfo docket was not captured.").when(nothing, "").otherwise(known["subtitle"]).alias("detail"),
    )


def parties(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, idx, name, party_type, attorneys): the record's parties, else those of its caption."""
    direct = casefacts.part(rows, key, record, "parties").where("name <> '' or party_type <> ''")
    v = F.try_parse_json(F.col(record))
    title = alias_text(v, ("case_title", "CASETITLE", "title"))
    t = rows.join(direct.select(key).distinct(), key, "left_anti").select(key, text.title_parties(title, is_portal(v)).alias("t"))
    kinds = F.array(*[F.struct(F.col(f"t.{n}").alias("name"), F.lit(f"{n.title()} (caption)").alias("party_type")) for n in ("plaintiff", "defendant", "subject")])
    caption = t.select(key, F.posexplode(F.filter(kinds, lambda k: k["name"].isNotNull())).alias("idx", "x")).select(key, "idx", "x.*", F.lit("").alias("attorneys"))
    return direct.select(key, "idx", "name", "party_type", "attorneys").unionByName(caption)


def attorneys(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, idx and fields) of the attorneys that are somebody."""
    rows = casefacts.part(rows, key, record, "attorneys")
    return rows.where(((F.col("name") != "") | (F.col("bar_number") != "") | (F.col("address") != "") | (F.col("role") != "")) & ~casefacts.is_artefact(F.col("name")))


def representation(parties: DataFrame, attorneys: DataFrame, key: str) -> DataFrame:
    """Distinct party-attorney edges of both sides' own lists."""
    at = lambda head, tail: F.concat(F.lit(f"{head}["), F.col("idx").cast("string"), F.lit(f"].{tail}"))
    a = parties.select(key, F.explode(clean_attorneys(F.col("attorneys"))).alias("attorney_name"), text.clean(F.upper("name")).alias("party_name"), at("parties", "attorneys").alias("source_field"))
    b = attorneys.select(key, F.col("name").alias("attorney_name"), F.explode(text.represented_parties(F.col("represented"))).alias("party_name"), at("attorneys", "parties_represented").alias("source_field"))
    rows = a.unionByName(b).withColumn("edge", F.lower(F.concat_ws("|", "party_name", "attorney_name", "source_field")))
    return rows.groupBy(key, "edge").agg(F.min(F.struct("party_name", "attorney_name", "source_field")).alias("e")).select(key, "e.*")


def date_text(x: Column) -> Column:
    """ISO date found in the text, else its first ten characters."""
    return F.coalesce(_present(dates.find_iso(x)), F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, 10))
