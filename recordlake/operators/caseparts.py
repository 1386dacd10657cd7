"""A case's record put together: header, parts in order, counts, dates and status, parsed once.

Everything is read off the record's own row by expressions over its lists, so there is no
join and no shuffle, rows that repeat a key stay rows of their own, and a part's
size is bounded by the text it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from . import casefacts
from .captions import clean_attorney_lists
from .casefacts import ALIASES, alias_text
from .portal import Portal, _present, calendar_entry, field, is_portal, source_url, with_header

#: Parts in the order in which case_parts numbers them.
PARTS = ("docket_events", "documents", "parties", "attorneys", "representation_edges", "calendar", "payments")
DIRECT_DATES = ("filing_date", "filed_date", "filedDate", "date_filed", "FILEDATE", "filed")


def _list(v: Column, name: str) -> Column:
    none = F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), none)


def _objects(v: Column, name: str) -> Column:
    """A part's rows as maps of texts, each decoded once; what is no object is null."""
    kind = "array<map<string,string>>"
    return F.coalesce(F.try_variant_get(v, f"$.{name}", kind), F.array().cast(kind))


def _first_of(e: Column, names: tuple[str, ...]) -> Column:
    """First non-blank text of a map's fields."""
    return text.first_text(*[F.try_element_at(e, F.lit(n)) for n in names])


def _entries(v: Column, name: str) -> Column:
    """A part's rows as structs of idx and fields; blank ones go."""
    read = lambda e, i: F.struct(i.alias("idx"), *[_first_of(e, names).alias(n) for n, names in ALIASES[name].items()])
    return F.filter(F.transform(_objects(v, name), read), lambda r: text.any_of([r[n] != "" for n in ALIASES[name]]))


def _register(v: Column) -> Column:
    """The register of actions as docket rows."""
    names = ALIASES["docket_entries"]
    read = lambda e, i: F.struct(i.alias("idx"), *[_first_of(e, names[n]).alias(n) if n in ("date_filed", "description") else F.lit("").alias(n) for n in names])
    return F.transform(_objects(v, "roa"), read)


def _caption(v: Column, criminal: Column) -> Column:
    """Parties that the title names."""
    t = text.title_parties(alias_text(v, ("case_title", "CASETITLE", "title")), criminal)
    kinds = F.array(*[F.struct(t[n].alias("name"), F.lit(f"{n.title()} (caption)").alias("party_type")) for n in ("plaintiff", "defendant", "subject")])
    return F.transform(F.filter(kinds, lambda k: k["name"].isNotNull()), lambda k, i: F.struct(i.alias("idx"), k["name"].alias("name"), k["party_type"].alias("party_type"), F.lit("").alias("attorneys")))


def _edges(parties: Column, names: Column, counsel: Column) -> Column:
    """Distinct party-attorney edges of both sides' own lists."""
    at = lambda head, r, tail: F.concat(F.lit(f"{head}["), r["idx"].cast("string"), F.lit(f"].{tail}"))

    def edge(party: Column, attorney: Column, source: Column) -> Column:
        return F.struct(F.lower(F.concat_ws("|", party, attorney, source)).alias("edge"), party.alias("party_name"), attorney.alias("attorney_name"), source.alias("source_field"))

    a = F.flatten(F.zip_with(parties, names, lambda p, n: F.transform(n, lambda x: edge(text.clean(F.upper(p["name"])), x, at("parties", p, "attorneys")))))
    b = F.flatten(F.transform(counsel, lambda c: F.transform(text.represented_parties(c["represented"]), lambda x: edge(x, c["name"], at("attorneys", c, "parties_represented")))))

    def once(every: Column) -> Column:
        new = lambda e, i: F.coalesce(F.get(every, i - 1)["edge"] != e["edge"], F.lit(True))
        return F.transform(F.filter(every, new), lambda e: F.struct(e["party_name"].alias("party_name"), e["attorney_name"].alias("attorney_name"), e["source_field"].alias("source_field")))

    return F.transform(F.array(F.array_sort(F.concat(a, b))), once)[0]  # sorted once


def _by_date(entries: Column, *order: str, undated_last: bool = False) -> Column:
    """Rows by date, then by the other fields; those without a date first, or last."""
    last = lambda r: (r[order[0]] == "") if undated_last else F.lit(False)
    return F.transform(F.array_sort(F.transform(entries, lambda r: F.struct(last(r).alias("last"), *[r[o].alias(f"o{i}") for i, o in enumerate(order)], r.alias("r")))), lambda x: x["r"])


def _parts(rows: DataFrame, key: str, record: str, p: Portal) -> DataFrame:
    """`key`, the variant `v`, the portal's header (or null) and every part as a list of structs, as they stand in the record."""
    x = with_header(rows.select(F.col(key).alias("_key"), F.try_parse_json(F.col(record)).alias("v")), p)
    v = F.col("v")
    direct = F.filter(_entries(v, "parties"), lambda r: (r["name"] != "") | (r["party_type"] != ""))
    docket = _entries(v, "docket_entries")
    counsel = F.filter(_entries(v, "attorneys"), lambda r: text.any_of([r[n] != "" for n in ("name", "bar_number", "address", "role")]) & ~casefacts.is_artefact(r["name"]))
    calendar = F.transform(_list(v, "calendar"), lambda e, i: F.struct(i.alias("idx"), calendar_entry(e).alias("c")))
    x = x.withColumns({"_docket": docket, "_direct": direct, "attorneys": counsel, "_documents": _entries(v, "documents"), "_payments": _entries(v, "payments"), "calendar": calendar})
    x = x.withColumn("parties", F.when(F.size("_direct") > 0, F.col("_direct")).otherwise(_caption(v, is_portal(v, p))))
    x = x.withColumn("_entries", F.when(F.size("_docket") > 0, F.col("_docket")).otherwise(_register(v)))
    x = x.withColumn("_names", clean_attorney_lists(F.transform("parties", lambda r: r["attorneys"])))
    x = x.withColumn("representation_edges", _edges(F.col("parties"), F.col("_names"), F.col("attorneys")))
    parts = {"docket_events": "_entries", "documents": "_documents", "payments": "_payments"}
    return x.select(F.col("_key").alias(key), "v", "portal", *[F.col(parts.get(n, n)).alias(n) for n in PARTS])


def assembled(rows: DataFrame, key: str, record: str, p: Portal = Portal()) -> DataFrame:
    """`key`, the variant `v`, the portal's header (or null) and every part as a list of structs, in order."""
    x = _parts(rows, key, record, p)
    docket, documents = _by_date(F.col("docket_events"), "date_filed", "idx"), _by_date(F.col("documents"), "filed", "doc_id", "idx", undated_last=True)
    return x.withColumns({"docket_events": docket, "documents": documents, "payments": _by_date(F.col("payments"), "date", "idx")})


def case_parts(rows: DataFrame, key: str, record: str, p: Portal = Portal()) -> DataFrame:
    """(key, part, place, idx, fields): the rows of all parts, tagged, with their place in order from 0.

    idx is the row's place in the record (null for edges, which have none).
    """
    x = assembled(rows, key, record, p)
    types = dict(x.dtypes)

    def tagged(name: str) -> Column:
        own = x.schema[name].dataType.elementType
        inner = own["c"].dataType if name == "calendar" else own
        read = lambda r, f: (r["c"][f] if name == "calendar" else r[f]).cast("string")
        names = [f for f in inner.names if f != "idx"]
        fields = lambda r: F.create_map(*[c for f in names for c in (F.lit(f), read(r, f))])
        idx = (lambda r: r["idx"].cast("int")) if "idx" in own.names else (lambda r: F.lit(None).cast("int"))
        return F.transform(name, lambda r, i: F.struct(F.lit(name).alias("part"), i.cast("int").alias("place"), idx(r).alias("idx"), fields(r).alias("fields")))

    assert all(n in types for n in PARTS)
    return x.select(F.col(key), F.explode(F.concat(*[tagged(n) for n in PARTS])).alias("x")).select(key, "x.*")


def first_dated(own: Column, docket: Column, documents: Column) -> Column:
    """Text of the record's own date, else of its first complaint or petition, dated docket row, or dated document."""
    complaint = lambda r: r["description"].rlike(r"(?i)\b(?:complaint|petition)\b")
    anchor = F.array_min(F.transform(F.filter(docket, lambda r: r["date_filed"] != ""), lambda r: F.struct(F.when(complaint(r), 0).otherwise(1).alias("k"), r["idx"].alias("i"), r["date_filed"].alias("d"))))
    doc = F.array_min(F.transform(F.filter(documents, lambda r: r["filed"] != ""), lambda r: F.struct(r["idx"].alias("i"), r["filed"].alias("d"))))
    return text.first_text(own, anchor["d"], doc["d"])


def date_of(raw: Column) -> Column:
    return F.coalesce(F.nullif(dates.find_iso(raw), F.lit("")), F.substring(raw, 1, 10))


def case_facts(rows: DataFrame, key: str, record: str, p: Portal = Portal()) -> DataFrame:
    """One row a record (JSON text): header, filing date, source, and counts and flags of its parts.

    Portal records are normalised first.  Records that repeat a key have a row each.
    """
    x = _parts(rows, key, record, p)  # counts and the filing date do not ask for an order
    v, h = F.col("v"), lambda name: F.col(f"portal.{name}")
    head = lambda name, *names: F.coalesce(h(name), alias_text(v, names)).alias(name)
    own = F.coalesce(_present(alias_text(v, DIRECT_DATES)), alias_text(F.try_variant_get(v, "$.case_header", "variant"), DIRECT_DATES))
    x = x.withColumn("_own", own).withColumn("_filed", first_dated(F.col("_own"), F.col("docket_events"), F.col("documents")))
    notice = F.coalesce(h("unavailable_text"), alias_text(v, ("unavailable_text", "unavailable_red_text", "unavailable_reason", "message")))
    status = F.coalesce(h("status"), field(v, "status"))
    closed = (F.lower(status) == "unavailable") | (notice != "")
    said = casefacts.open_status(*[field(v, *path) for path in (("court_case_status",), ("case_status",), ("status",), ("case_header", "court_case_status"), ("case_header", "case_status"), ("case_header", "status"))])
    url = F.coalesce(h("source_url"), source_url(v, p))
    n = lambda c: F.size(c).cast("long")
    held = n(F.filter("documents", lambda d: d["sha256"] != ""))
    title = head("case_title", "case_title", "CASETITLE", "title")
    return x.select(
        key, head("case_number", "case_number", "CASE_NUMBER", "caseNum"), title, head("court", "court", "COURT"),
        head("cause_of_action", "cause_of_action", "cause", "CAUSE"), date_of(F.col("_filed")).alias("filing_date"),
        alias_text(v, ("captured_at", "capturedAt")).alias("captured_at"), url.alias("source_url"),
        n("docket_events").alias("docket_events"), n("documents").alias("documents"), held.alias("captured_documents"), (n("documents") - held).alias("metadata_only_documents"),
        n("parties").alias("parties"), n("attorneys").alias("attorneys"), n("representation_edges").alias("representation_edges"), n("calendar").alias("calendar_rows"),
        n("payments").alias("financial_rows"), (url != "").alias("has_source_url"), (title != "").alias("has_case_title"),
        F.when(closed, "unavailable").when(said != "", "affirmatively_open").otherwise("unknown").alias("case_status"),
    )
