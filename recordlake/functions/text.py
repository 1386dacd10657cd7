"""Text normalisers, keys and classifications as Column -> Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (
    ACRONYMS,
    CAPTION_SPLIT,
    CATEGORY_BY_INITIAL,
    CONNECTORS,
    COURT_GROUPS,
    GENERIC_TITLE,
    GOVERNMENT_RULES,
    GROUP_ORDER,
    HONORIFICS,
    MATTER_PREFIXES,
    NAME_SUFFIXES,
    OFFICER_TITLES,
    PARTY_ROLES,
    PEOPLE,
    PREFIX_NAMES,
    PREFIX_TYPE_NAMES,
    PRIVATE_FIRM,
    SMALL_WORDS,
    SUBJECT_TITLE,
)

SPACE = r"(?U)\s+"


def clean(x: Column) -> Column:
    """Null to '', any run of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " "))


def clean_inline(x: Column) -> Column:
    return clean(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)<br\s*/?>", " "))


def search_key(x: Column) -> Column:
    """Lower case; everything but a-z and 0-9 becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def category_key(x: Column) -> Column:
    x = F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, "[^a-z0-9]+", " ")
    return clean(F.regexp_replace(x, rf"\b(?:{'|'.join(SMALL_WORDS)})\b", " "))


def officer_key(x: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), OFFICER_TITLES, " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def officer_identity(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """officer_key, then a reviewed alias if there is one."""
    key = officer_key(x)
    if not aliases:
        return key
    pairs = F.create_map(*[F.lit(v) for kv in sorted(aliases.items()) for v in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def person_label(x: Column) -> Column:
    """Leading honorifics and edge punctuation removed."""
    return F.regexp_replace(F.regexp_replace(clean(x), HONORIFICS, ""), r"^[\s,:;-]+|[\s,:;-]+$", "")


def name_key(x: Column) -> Column:
    """Comparable name: & spelled out, upper case, company suffixes dropped."""
    x = F.upper(F.replace(clean(x), F.lit("&"), F.lit(" AND ")))
    x = F.trim(F.regexp_replace(x, "[^A-Z0-9]+", " "))
    return clean(F.regexp_replace(x, rf"\b(?:{'|'.join(NAME_SUFFIXES)})\b", " "))


def compact_key(x: Column) -> Column:
    k = F.replace(search_key(x), F.lit(" "), F.lit("_"))
    return F.when(k == "", F.lit("unknown")).otherwise(k)


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.lower(clean(x)), r"[^\p{L}\p{N}]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def record_key(x: Column) -> Column:
    """Upper case without hyphen, underscore and space."""
    return F.upper(F.translate(clean(x), "-_ ", ""))


def strict_record_key(x: Column) -> Column:
    """Upper case, only A-Z and 0-9."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def record_prefix(x: Column) -> Column:
    return F.upper(F.regexp_extract(clean(x), r"\p{L}+", 0))


def record_category(x: Column) -> Column:
    p = record_prefix(x)
    out = F.when(p == "CRI", "Criminal").when(p == "DPO", "Family").when(p == "", "Legacy")
    for initial, name in CATEGORY_BY_INITIAL.items():
        out = out.when(p.startswith(initial), name)
    return out.otherwise("Other")


def inferred_matter_type(x: Column) -> Column:
    p = F.regexp_extract(strict_record_key(x), "^[A-Z]+", 0)
    out = F.lit("Unclassified")
    for name, prefixes in MATTER_PREFIXES.items():
        out = F.when(p.isin(*prefixes), name).otherwise(out)
    return out


def prefix_code(x: Column) -> Column:
    c = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), "[^A-Z0-9]", "")
    return F.when((F.trim(F.coalesce(x, F.lit(""))) == "(none)") | (c == ""), "(none)").otherwise(c)


def prefix_info(x: Column) -> Column:
    """struct(code, grp, name, label, retired_year, grp_sort)."""
    code = prefix_code(x)
    known = F.create_map(*[v for k, (g, n, y) in PREFIX_NAMES.items() for v in (F.lit(k), F.struct(F.lit(g).alias("g"), F.lit(n).alias("n"), F.lit(y).cast("int").alias("y")))])
    groups = F.create_map(*[F.lit(v) for kv in COURT_GROUPS.items() for v in kv])
    types = F.create_map(*[F.lit(v) for kv in PREFIX_TYPE_NAMES.items() for v in kv])
    g2, n2 = F.try_element_at(groups, F.substring(code, 1, 1)), F.try_element_at(types, F.substring(code, 2, 2))
    derived = F.when(code.rlike("^[A-Z][A-Z0-9]{2}$") & g2.isNotNull() & n2.isNotNull(), F.struct(g2.alias("g"), n2.alias("n"), F.lit(None).cast("int").alias("y")))
    official = F.coalesce(F.try_element_at(known, code), derived)
    none = code == "(none)"
    grp = F.when(none, "Legacy").otherwise(F.coalesce(official["g"], F.lit("Other")))
    name = F.when(none, "No Prefix / Legacy").otherwise(F.coalesce(official["n"], code))
    label = F.when(none | official.isNull(), name).when(grp == "Criminal", "Criminal").otherwise(F.concat(grp, F.lit(" - "), name))
    order = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), grp) - 1
    return F.struct(code.alias("code"), grp.alias("grp"), name.alias("name"), label.alias("label"), official["y"].alias("retired_year"), order.cast("int").alias("grp_sort"))


def government_bucket(x: Column) -> Column:
    t = F.upper(clean(x))
    out = F.when(t == "", "Other Government")
    for name, pattern in GOVERNMENT_RULES:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("Other Government")


def private_firm_signal(x: Column) -> Column:
    t = clean(x)
    return t.rlike(PRIVATE_FIRM) | (t.contains("&") & (F.size(F.split(t, " ")) >= 2))


def firm_category(name: Column, attorneys: Column) -> Column:
    return F.when(private_firm_signal(name), "Private").when(F.coalesce(attorneys, F.lit(0)) <= 1, "Solo").otherwise("Private")


def as_list(x: Column) -> Column:
    """Split at ; and newline; trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), "[;\n]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def unique_texts(a: Column) -> Column:
    """Trimmed non-blank entries, the first of each ignoring case."""
    items = F.filter(F.transform(a, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")
    empty = F.array().cast("array<string>")
    fresh = lambda acc, p: F.when(F.exists(acc, lambda q: F.upper(q) == F.upper(p)), acc).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(items, empty, fresh)


def first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def json_list(x: Column, item: str = "string") -> Column:
    """A JSON list in a string; anything else is an empty list."""
    parsed = F.from_json(x, f"array<{item}>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast(f"array<{item}>"))


def loose_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "y"), F.lit(False))


def count_or_null(x: Column) -> Column:
    n = x.try_cast("long")
    return F.when(n >= 0, n)


def optional_number(x: Column) -> Column:
    n = F.nullif(F.trim(x), F.lit("")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def safe_path(x: Column) -> Column:
    """The path, or null if it is empty or climbs."""
    p = F.trim(F.coalesce(x, F.lit("")))
    return F.when((p != "") & ~F.array_contains(F.split(p, "/"), ".."), p)


def strip_party_roles(x: Column) -> Column:
    s = clean(F.regexp_replace(F.coalesce(x, F.lit("")), _roles(), " "))
    extra = F.greatest(F.lit(0), F.regexp_count(s, F.lit(r"\)")) - F.regexp_count(s, F.lit(r"\(")))
    tail = F.length(s) - F.length(F.regexp_replace(s, r"[)\s]+$", ""))
    cut = F.when((extra > 0) & (tail > 0), F.regexp_replace(s, r"\s*\)$", "")).otherwise(s)
    return F.regexp_replace(cut, "^[ ,;]+|[ ,;]+$", "")


def _roles() -> str:
    return rf"(?i)\(\s*(?:(?:AND|&|/)\s+)*(?:{'|'.join(PARTY_ROLES)})\b[^)]*\)?"


def represented_parties(x: Column) -> Column:
    """Names between role parentheses, upper case, distinct in order."""
    pieces = F.flatten(F.transform(as_list(x), lambda r: F.split(r, _roles())))
    names = F.transform(pieces, lambda p: F.upper(strip_party_roles(p)))
    return unique_texts(F.filter(names, lambda p: p.rlike("[A-Z0-9]")))


def caption_name(x: Column) -> Column:
    """One side of a caption: edge punctuation and 'et al.' go, the people are spelled out; '' for a generic title."""
    s = F.regexp_replace(clean_inline(x), PEOPLE, "People of the State of California")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\s+(?:et\s+al\.?|et\s+ux\.?)\s*$", ""), r"^[,;:.\s]+|[,;:.\s]+$", "")
    return F.when(s.rlike(GENERIC_TITLE), "").otherwise(s)


def title_parties(title: Column, criminal: Column | None = None) -> Column:
    """struct(plaintiff, defendant, subject) from a caption; none from a generic or criminal one.

    All sides but the first are the defendant, joined by ' v. '.  Without
    `criminal`, a caption that begins with the people is taken as criminal.
    """
    t = clean_inline(title)
    skip = t.rlike(GENERIC_TITLE) | (t.rlike(r"(?i)^(?:the\s+)?people\b") if criminal is None else F.coalesce(criminal, F.lit(False)))
    sides = F.filter(F.transform(F.split(t, CAPTION_SPLIT), caption_name), lambda s: s != "")
    read = F.struct(F.when(~skip, sides).alias("sides"), F.when(~skip, caption_name(F.regexp_extract(t, SUBJECT_TITLE, 1))).alias("subject"))

    def named(r: Column) -> Column:
        s, two = r["sides"], F.size(r["sides"]) >= 2
        return F.struct(
            F.when(two, F.get(s, F.lit(0))).alias("plaintiff"),
            F.when(two, F.array_join(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), " v. ")).alias("defendant"),
            F.when(~two & (r["subject"] != ""), r["subject"]).alias("subject"),
        )

    return F.transform(F.array(read), named)[0]  # every part is computed once


def without_parameter(url: Column, name: str) -> Column:
    """The URL without one query parameter."""
    u = F.regexp_replace(url, rf"(?i)([?&]){name}=[^&#]*&?", "$1")
    return F.regexp_replace(u, r"[?&](?=#|$)", "")


def criminal_archive_number(explicit: Column, number: Column) -> Column:
    """CRI and the digits: as it stands, rebuilt from the raw number, else the number in capitals."""
    n = F.upper(F.trim(F.coalesce(number, F.lit(""))))
    raw = criminal_raw_number(explicit, number)
    return F.when(n.rlike(r"^CRI\d{6,}$") | (raw == ""), n).otherwise(F.concat(F.lit("CRI"), raw))


def criminal_raw_number(explicit: Column, number: Column) -> Column:
    """Digits of the explicit number, else of a criminal case number, else ''."""
    own = F.trim(F.coalesce(explicit, F.lit("")))
    return F.when(own != "", F.regexp_replace(own, "[^0-9]", "")).otherwise(F.regexp_extract(F.trim(F.coalesce(number, F.lit(""))), r"(?i)^CRI[-_\s]*(\d{6,})$", 1))


def digits_after_prefix(x: Column) -> Column:
    return F.regexp_extract(F.upper(clean(x)), r"^[A-Z]+[-_\s]*(\d+)", 1)


def shard_path(x: Column) -> Column:
    """PREFIX/YY/KEY.json, digits first, or a miscellaneous place."""
    k = F.upper(clean(x))
    yy = F.regexp_extract(k, r"^[A-Z]+[-_]?(\d{2})", 1)
    p = F.regexp_extract(k, r"^([A-Z]+)[-_]?\d{2}", 1)
    yy2, p2 = F.regexp_extract(k, r"^(\d{2})[-_]?[A-Z]+", 1), F.regexp_extract(k, r"^\d{2}[-_]?([A-Z]+)", 1)
    where = F.when(p != "", F.concat_ws("/", p, yy)).when(p2 != "", F.concat_ws("/", p2, yy2)).otherwise("_MISC/unknown")
    return F.concat(where, F.lit("/"), k, F.lit(".json"))


def pretty_label(x: Column) -> Column:
    """Title case for labels in capitals; acronyms stay, connectors are lower case.

    A leading conjunction and trailing punctuation and conjunctions go.  A label with a small letter outside parentheses stays as it is.  Else every run between
    blanks, parentheses and section signs is judged by its letters and digits alone:
    A.D.A. is the acronym ADA and stays; AND/OR, whose letters do not stand together, stays
    as well.  The first letter is a capital.
    """
    s = F.regexp_replace(clean(x), r"(?i)^(?:and|&)\s+|(?:[\s;,.:]|\s(?:and|&))+$", "")
    acronyms, connectors = (F.array(*map(F.lit, words)) for words in (ACRONYMS, CONNECTORS))
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def put(w: Column, bare: Column) -> Column:
        at = F.instr(w, bare)
        spelled = F.concat(w.substr(F.lit(1), at - 1), F.upper(F.substring(bare, 1, 1)), F.lower(bare.substr(F.lit(2), F.length(bare))), w.substr(at + F.length(bare), F.length(w)))
        return F.when((bare == "") | F.array_contains(acronyms, F.upper(bare)), w).when(F.array_contains(connectors, F.lower(bare)), F.lower(w)).when(at > 0, spelled).otherwise(w)

    def spell(label: Column) -> Column:
        runs = F.regexp_extract_all(label, F.lit(r"\s+|[()§]|[^\s()§]+"), F.lit(0))
        return F.array_join(F.transform(runs, lambda w: once(F.regexp_replace(w, "[^A-Za-z0-9'’-]", ""), lambda bare: put(w, bare))), "")

    def capital(label: Column) -> Column:
        return once(F.regexp_instr(label, F.lit("[A-Za-z]")), lambda at: F.when(at > 0, F.concat(label.substr(F.lit(1), at - 1), F.upper(label.substr(at, F.lit(1))), label.substr(at + 1, F.length(label)))).otherwise(label))

    def judge(label: Column) -> Column:
        return F.when(~F.regexp_replace(label, r"\([^)]*\)", "").rlike("[a-z]"), clean(once(spell(label), capital))).otherwise(label)

    return once(s, judge)


def money_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit("$"), F.format_number(x, 2)))


def confidence_text(x: Column) -> Column:
    """Percent with one decimal, none for a certain one; 'not stated' without one."""
    pct = F.concat(F.when(x == 1, "100").otherwise(F.format_string("%.1f", x * 100)), F.lit("%"))
    return F.when(x.isNull(), "not stated").otherwise(pct)


def amount_text(x: Column) -> Column:
    """A decimal in words of the source: $ and thousands, digits after the point as given; other text as it is."""
    raw = F.regexp_replace(F.trim(F.coalesce(x.cast("string"), F.lit(""))), ",", "")
    sign, whole, rest = (F.regexp_extract(raw, r"^(-?)(\d+)(\.\d+)?$", i) for i in (1, 2, 3))
    grouped = F.regexp_replace(whole, r"\B(?=(\d{3})+(?!\d))", ",")
    return F.when(whole != "", F.concat(sign, F.lit("$"), grouped, F.coalesce(rest, F.lit("")))).when(raw == "", "not stated").otherwise(raw)


def percent_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")))


def bytes_text(x: Column) -> Column:
    kb, mb = x / 1024.0, x / 1048576.0
    return F.when(x < 1048576, F.concat(F.format_string("%.2f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", mb), F.lit(" MB")))


def text_op(value: Column, op: str, wanted: str) -> Column:
    """contains, not_contains, exact, starts, ends or regex, ignoring case; a bad pattern matches nothing."""
    import re

    v, w = F.lower(F.coalesce(value, F.lit(""))), wanted.lower()
    if op == "regex":
        try:
            re.compile(wanted)
        except re.error:
            return F.lit(False)
        return F.coalesce(value, F.lit("")).rlike(f"(?i){wanted}")
    return {"contains": v.contains(w), "not_contains": ~v.contains(w), "exact": v == w, "starts": v.startswith(w), "ends": v.endswith(w)}[op]


def json_map(x: Column) -> Column:
    """A JSON object of counts in a string; anything else is an empty map."""
    return F.coalesce(F.from_json(x, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def prefix_order(x: Column) -> Column:
    """Sort key of a prefix: group, then label, then code."""
    i = prefix_info(x)
    return F.struct(i["grp_sort"].alias("grp_sort"), i["label"].alias("label"), i["code"].alias("code"))


def prefix_label(x: Column) -> Column:
    """Label with the code in parentheses."""
    i = prefix_info(x)
    return F.when(i["code"] == "(none)", i["label"]).otherwise(F.concat(i["label"], F.lit(" ("), i["code"], F.lit(")")))


def finite_or_zero(x: Column) -> Column:
    n = x.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)


def not_negative(x: Column) -> Column:
    return F.greatest(F.lit(0.0), finite_or_zero(x))


def plural(n: Column, one: str, many: str) -> Column:
    """The count with thousands and its word."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
