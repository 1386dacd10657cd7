"""Causes listed in a pleading's caption, and charges in index text: scans with state, as Arrow functions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text
from ..functions.fixed import (
    ACRONYMS,
    CANONICAL_CAUSES,
    CHARGE_SENTINEL,
    CITES_STATUTE,
    CODE_ALIASES,
    CODE_NAMES,
    CODE_SPELLINGS,
    CONNECTORS,
    HEADED_BRACKETS,
    HEADED_LINE,
    INLINE_CITATION,
    JUNK_CAUSE,
    LAW_CODES,
    LAW_TEXT,
    NAME_ARTEFACT,
    NOT_A_CAUSE,
    NUMBERED_PARTY,
    ORDINALS,
    PARTY_START,
    PARTY_VERB,
    PETITION_FOR,
    PETITION_OTHER,
    PETITION_START,
    PLEADING_HEADING,
    PLEADING_PROSE,
    SECTION_NUMBER,
    STOP_PHRASES,
)

_MARK = re.compile(r"(?:^|(?<=[\s(\[]))\[?(\d{1,2})[\].)](?![)\]])")
_HEADING = re.compile(PLEADING_HEADING)
_HEADER = re.compile(rf"(?i)\b({'|'.join(sorted(ORDINALS, key=len, reverse=True))})\s+(?:and\s+\w+\s+)?causes?\s+of\s+action\b")
_STOP = re.compile("|".join(map(re.escape, STOP_PHRASES)), re.IGNORECASE)
CAPTION = 8000  # characters from the top that may hold a caption


def squish(s: str) -> str:
    return " ".join(s.split())


def pretty(label: str) -> str:
    """functions.text.pretty_label for one label."""
    s = re.sub(r"(?i)^(?:and|&)\s+|(?:[\s;,.:]|\s(?:and|&))+$", "", squish(label))
    if re.search("[a-z]", re.sub(r"\([^)]*\)", "", s)):
        return s

    def put(m: re.Match) -> str:
        w = m[0]
        bare = re.sub("[^A-Za-z0-9'’-]", "", w)
        if not bare or bare.upper() in ACRONYMS:
            return w
        return w.lower() if bare.lower() in CONNECTORS else w.replace(bare, bare[0].upper() + bare[1:].lower(), 1)

    return squish(re.sub("[A-Za-z]", lambda m: m[0].upper(), re.sub(r"[^\s()§]+", put, s), count=1))


def _tail_group(s: str) -> tuple[str, str] | None:
    """(text before, text inside) of a balanced parenthesis at the end."""
    s = s.rstrip()
    if not s.endswith(")"):
        return None
    depth = 0
    for i in range(len(s) - 1, -1, -1):
        depth += (s[i] == ")") - (s[i] == "(")
        if not depth:
            return s[:i], s[i + 1 : -1]
    return None


def split_citation(label: str) -> tuple[str, str | None]:
    """(label, statute) where the label ends in a parenthesis that cites one or in a code and section."""
    group, statute = _tail_group(label), None
    if group and re.search(CITES_STATUTE, group[1]):
        label, statute = group
    elif m := re.search(INLINE_CITATION, label):
        if len(rest := squish(label[: m.start()])) >= 3:
            label, statute = rest, m[1]
    return squish(label).rstrip(" ;,."), squish(statute).strip(" ()") if statute else None


def plausible(label: str) -> bool:
    """Whether a label can be a cause of action: no junk, form, heading, prose of the body or numbered party."""
    s = squish(label)
    if not 3 <= len(s) <= 180 or re.search(JUNK_CAUSE, s) or re.search(NOT_A_CAUSE, s) or _STOP.match(s):
        return False
    prose = re.search(r"[.!?]\s+[A-Z]", s) or re.search(PLEADING_PROSE, s) or re.search(NUMBERED_PARTY, s)
    return not (prose or (re.search(PARTY_START, s) and re.search(PARTY_VERB, s)))


def _cause(n: int, raw: str) -> dict | None:
    label, statute = split_citation(raw)
    label = pretty(label)
    return {"n": n, "label": label, "statute": statute} if plausible(label) else None


def _items(region: str) -> list[dict]:
    """The list 1, 2, 3 ... that starts soon; each item ends at the next marker or a stop phrase."""
    marks = [(int(m[1]), m.start(1), m.end()) for m in _MARK.finditer(region)]
    at = next((i for i, (n, place, _) in enumerate(marks) if n == 1 and place < 1200), None)
    out: list[dict] = []
    while at is not None:
        n, _, begin = marks[at]
        following = marks[at + 1] if at + 1 < len(marks) else (None, len(region), None)
        raw = squish(_STOP.split(region[begin : following[1]], maxsplit=1)[0])
        if plausible(raw):
            out += [c] if (c := _cause(n, raw)) else []
        elif out:
            break
        at = at + 1 if following[0] == n + 1 else None
    return out


def _listed(window: str) -> list[dict]:
    """The longest list behind a pleading's heading, the last heading first."""
    found = [_items(window[m.end() :]) for m in _HEADING.finditer(window)]
    return max(reversed(found), key=len, default=[])


def _headed(text: str) -> list[dict]:
    """Causes named behind headings FIRST CAUSE OF ACTION and so on, the first of each ordinal."""
    out: dict[int, dict] = {}
    for m in _HEADER.finditer(text):
        n, after = ORDINALS.index(m[1].lower()) + 1, text[m.end() : m.end() + 200]
        named = re.match(HEADED_BRACKETS, after) or re.match(HEADED_LINE, after)
        label = re.sub(r"(?i)\b(against|by|as to)\b.*$", "", squish(named[1])) if named else ""
        if label and n not in out and (c := _cause(n, label)):
            out[n] = c
    return [out[n] for n in sorted(out)]


def causes(text: str | None) -> list[dict]:
    """[{n, label, statute}] in pleaded order, distinct; the caption's list unless the headings give more."""
    if not text:
        return []
    flat = text.replace("\xa0", " ")
    listed, headed = _listed(flat[:CAPTION]), _headed(flat)
    out, seen = [], set()
    for c in listed if listed and len(listed) >= len(headed) else headed:
        key = re.sub("[^a-z0-9]+", " ", c["label"].lower()).strip()
        if key and key not in seen:
            seen.add(key)
            out.append(c)
    return out


def fallback_cause(label: str) -> list[dict]:
    """The only cause that a description gives, if it can be one."""
    named = pretty(label)
    return [{"n": 1, "label": named, "statute": None}] if plausible(named) else []


CAUSES = pa.list_(pa.struct([("n", pa.int32()), ("label", pa.string()), ("statute", pa.string())]))


def parse_causes(x: Column) -> Column:
    return arrow_udf(_causes, "array<struct<n:int,label:string,statute:string>>")(x)


def _causes(texts: pa.Array) -> pa.Array:
    return pa.array([causes(t) for t in texts.to_pylist()], CAUSES)


_BY_ALIAS = {a: k for k, names in CODE_ALIASES.items() for a in names}
_SPELLED = sorted({*_BY_ALIAS, *CODE_SPELLINGS}, key=len, reverse=True)
_CODES = "|".join(re.sub(r"\s*&\s*", r"\\s*&\\s*", a) if "&" in a else a.replace(" ", r"\s+") for a in _SPELLED)
_STATUTE = re.compile(rf"(?i)\b(?:(?P<c1>{_CODES})\s*(?:§|SECTION|SEC\.)?\s*(?P<s1>{SECTION_NUMBER})|(?P<s2>{SECTION_NUMBER})\s*(?P<c2>{_CODES}))(?=$|[^A-Za-z0-9])")
_CLASS = {"F": "felony", "M": "misdemeanor", "I": "infraction"}
_GRADE = re.compile(r"(?i)(?:^|[/\s-])([FMI])(?:$|[/\s-])")


def code_system(raw: str) -> str:
    k = squish(raw.upper().replace(".", ""))
    return _BY_ALIAS.get(k, k)


def _charge(raw: str, m: re.Match | None = None, provided: str = "") -> dict:
    """One row: what the text gives as a title, the code and section, the class; the title's final choice is made later."""
    raw = raw.strip(" ,")
    code, section = (code_system(m["c1"] or m["c2"]), m["s1"] or m["s2"]) if m else ("", "")
    known = code in CODE_NAMES
    grade = _GRADE.search(raw) if m else None
    citation = f"{CODE_NAMES[code]} § {section}" if known else None
    return {
        "raw": raw,
        "code": f"{code} {section}" if known else None,
        "citation": citation,
        "classification": _CLASS[grade[1].upper()] if grade else None,
        "code_system": code if known else None,
        "section": section if known else None,
        "provided_title": provided or None,
        "title": provided or citation or raw,
        "title_source": "criminal_index_text" if provided else "programmatic_citation" if known else "raw_index_text",
        "unparsed": m is None,
    }


def _unknown(sentinel: str) -> dict:
    return _charge(sentinel) | {"title": f"Unrecognized criminal index charge code {sentinel}"}


def _part_charges(part: str) -> list[dict]:
    found = list(_STATUTE.finditer(part))
    if not found:
        numbers = re.findall(CHARGE_SENTINEL, part)
        return [_unknown(x) for x in numbers] or [_charge(part)]
    if len(found) == 1:
        m = found[0]
        title = squish(f"{part[: m.start()]} {part[m.end() :]}".strip(" -:;,/"))
        title = re.sub(r"(?i)\b(?:felony|misdemeanor|infraction|F|M|I)\b\s*$", "", re.sub(r"(?i)^[/\s-]*[FMI]\b[/\s-]*", "", title))
        return [_charge(part, m, title.rstrip(" -:;,/").strip())]
    out, rest, at = [], [], 0
    for m in found:  # a class letter behind a slash belongs to the citation
        end = m.end() + (len(c[0]) if (c := re.match(r"(?i)\s*/\s*[FMI]\b", part[m.end() :])) else 0)
        out.append(_charge(part[m.start() : end], m))
        rest.append(part[at : m.start()])
        at = end
    return out + [_unknown(x) for x in re.findall(CHARGE_SENTINEL, " ".join([*rest, part[at:]]))]


def charges(value: str | None) -> list[dict]:
    """Charges of an index text, distinct: a row per citation, sentinel number, or part without either."""
    inline = re.sub(r"(?i)<br\s*/?>", " ", value or "")
    parts = [squish(x).strip(" ,") for x in re.split(r"\s*[;\n\r|]\s*", inline)]
    rows = [r for x in parts if x for r in _part_charges(x)]
    return list({str(r).lower(): r for r in reversed(rows)}.values())[::-1]


_CHARGE = [(n, pa.string()) for n in ("raw", "code", "citation", "classification", "code_system", "section", "provided_title", "title", "title_source")]
CHARGES = pa.list_(pa.struct([*_CHARGE, ("unparsed", pa.bool_())]))


def parse_charges(x: Column) -> Column:
    return arrow_udf(_charges, f"array<struct<{','.join(f'{n}:string' for n, _ in _CHARGE)},unparsed:boolean>>")(x)


def _charges(texts: pa.Array) -> pa.Array:
    return pa.array([charges(t) for t in texts.to_pylist()], CHARGES)


def charge_title(provided: Column, schedule: Column, schedule_source: Column, citation: Column, raw: Column) -> Column:
    """struct(title, title_source, schedule_title): the text's own title, the schedule's, the citation, the raw part."""
    own, listed, cited = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (provided, schedule, citation))
    source = (
        F.when(own.isNotNull(), "criminal_index_text").when(listed.isNotNull(), F.coalesce(schedule_source, F.lit("court_bail_schedule")))
        .when(cited.isNotNull(), "programmatic_citation").otherwise("raw_index_text")
    )
    other = F.when(own.isNotNull() & (F.lower(listed) != F.lower(own)), listed)
    return F.struct(F.coalesce(own, listed, cited, raw).alias("title"), source.alias("title_source"), other.alias("schedule_title"))


def law_url(system: Column, section: Column) -> Column:
    """The official text of a section, without its subdivisions; '' for an unknown code."""
    laws = F.create_map(*[F.lit(v) for kv in LAW_CODES.items() for v in kv])
    law, base = F.try_element_at(laws, system), F.trim(F.regexp_replace(F.coalesce(section, F.lit("")), r"\(.*$", ""))
    url = F.concat(F.lit(f"{LAW_TEXT}?sectionNum="), F.url_encode(F.concat(base, F.lit("."))), F.lit("&lawCode="), law)
    return F.when(law.isNull() | (base == ""), "").otherwise(url)


def canonical_causes(labels: Column) -> Column:
    """Distinct struct(slug, name) of the causes: combined captions are taken apart, what is none goes."""
    known = F.create_map(*[x for k, v in CANONICAL_CAUSES.items() for x in (F.lit(k), _models(v))])

    def models(label: Column) -> Column:
        words = text.clean_inline(label)
        own = F.array(F.struct(text.slug(words).alias("slug"), F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words))).alias("name")))
        return F.coalesce(F.try_element_at(known, F.lower(words)), own)

    return F.array_distinct(F.flatten(F.transform(F.filter(labels, lambda x: text.clean_inline(x) != ""), models)))


def _models(pairs) -> Column:
    if not pairs:
        return F.array().cast("array<struct<slug:string,name:string>>")
    return F.array(*[F.struct(F.lit(s).alias("slug"), F.lit(n).alias("name")) for s, n in pairs])


def petition_for(description: Column) -> Column:
    """The relief that a petition's description names, in title case, else null."""
    s = F.regexp_replace(text.clean(description), PETITION_START, "")
    first, second = F.regexp_extract(s, PETITION_FOR, 1), F.regexp_extract(s, PETITION_OTHER, 1)
    relief = F.regexp_replace(text.clean(F.when(first != "", first).otherwise(second)), r"[\s,;:.]+$", "")
    relief = text.clean(F.regexp_replace(F.regexp_replace(relief, r"\[[^\]]*\]", " "), r"[\[\]]", " "))
    return F.when(F.length(relief) >= 3, text.pretty_label(relief))


def fallback_causes(x: Column) -> Column:
    """fallback_cause() of a column."""
    return arrow_udf(_fallbacks, "array<struct<n:int,label:string,statute:string>>")(x)


def _fallbacks(values: pa.Array) -> pa.Array:
    return pa.array([fallback_cause(v) if v else [] for v in values.to_pylist()], CAUSES)


_SELF = re.compile(r"(?i)^\s*(?:in\s+)?(?:pro\s*per|pro\s*se)\s*$")
_ARTEFACT = re.compile(NAME_ARTEFACT)


def attorney_names(value: str | None) -> list[str]:
    """Upper-case LAST, FIRST[, JR] names of a list; markers of self-representation go."""
    out: list[str] = []
    for raw in re.split(r"[;\n]", value or ""):
        s = re.sub(r"(?i)<br\s*/?>|\(Deactive[^)]*\)", "", raw)
        s = re.sub(r"(?i)(?<=[a-z])pro\s*per\b", ", PRO PER", s)
        parts = [p.strip(" `;") for p in squish(s).split(",")]
        parts = [p for p in parts if p and not _SELF.match(p) and not _ARTEFACT.match(p)]
        i = 0
        while i < len(parts):
            name, i = parts[i], i + 1
            if i < len(parts):
                name, i = f"{name}, {parts[i]}", i + 1
                if i < len(parts) and re.fullmatch(r"(?i)JR\.?|SR\.?|II|III|IV|V", parts[i]):
                    name, i = f"{name}, {parts[i]}", i + 1
            name = name.strip(" ,;`").upper()
            if name and name not in out:
                out.append(name)
    return out


def clean_attorneys(x: Column) -> Column:
    return arrow_udf(_attorneys, "array<string>")(x)


def clean_attorney_lists(x: Column) -> Column:
    """clean_attorneys of every text of a list."""
    return arrow_udf(_attorney_lists, "array<array<string>>")(x)


def _attorney_lists(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [attorney_names(s) for s in v] for v in values.to_pylist()], pa.list_(pa.list_(pa.string())))


def _attorneys(values: pa.Array) -> pa.Array:
    return pa.array([attorney_names(v) for v in values.to_pylist()], pa.list_(pa.string()))
