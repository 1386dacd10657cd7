"""Dates in text; results are ISO text, compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _slash(t: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(t, pattern, i)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))


def to_iso(x: Column) -> Column:
    """A date at the start: ISO, MON-DD-YYYY or M/D/YYYY, else null."""
    t = F.trim(x)
    iso = F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    mon = r"^([A-Za-z]{3})-(\d{1,2})-(\d{4})"
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(t, mon, 1)))
    named = F.when(number > 0, F.concat_ws("-", F.regexp_extract(t, mon, 3), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, mon, 2), 2, "0")))
    return F.coalesce(iso, named, _slash(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})"))


def find_iso(x: Column) -> Column:
    """The first ISO or M/D/YYYY date anywhere, else ''."""
    token = F.regexp_extract(clean(x), r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\b", 1)
    slash = _slash(token, r"^(\d{1,2})/(\d{1,2})/(\d{4})$")
    return F.when(token.rlike(r"^\d{4}-"), token).otherwise(F.coalesce(slash, F.lit("")))


def status_date(x: Column) -> Column:
    """find_iso, or MON D, YYYY anywhere."""
    p = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-\s](\d{1,2})[,\s-]+\s*(\d{4})\b"
    n = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(x, p, 1)))
    named = F.when(n > 0, F.concat_ws("-", F.regexp_extract(x, p, 3), F.lpad(n.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, p, 2), 2, "0")))
    return F.coalesce(F.nullif(find_iso(x), F.lit("")), named)


def date_and_time(x: Column) -> Column:
    t = clean(x)
    return F.struct(find_iso(t).alias("date"), F.regexp_extract(t, r"(\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp][Mm])?)", 1).alias("time"))


def record_year(number: Column, filed: Column, as_of_year: int) -> Column:
    """The filing date's year, else the number's two digits around the pivot, else null."""
    explicit = F.regexp_extract(clean(filed), r"^(\d{4})", 1)
    yy = F.regexp_extract(clean(number), r"^[A-Za-z]+[-\s_]*(\d{2})", 1)
    pivot = (as_of_year + 1) % 100
    two = F.when(yy != "", F.when(yy.cast("int") <= pivot, 2000 + yy.cast("int")).otherwise(1900 + yy.cast("int")))
    return F.coalesce(F.nullif(explicit, F.lit("")).cast("int"), two)


def short_date(d: Column, text: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.substring(text, 1, 10))
