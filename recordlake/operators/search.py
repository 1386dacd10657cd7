"""Trigram index, fielded search language and set algebra with negation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import QUERY_FIELDS
from ..functions.hashing import fnv1a32
from .rankings import capped


def _grams(s: Column) -> Column:
    n = F.length(s)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(s, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the spaced and the space-less normal form."""
    k = text.search_key(x)
    return F.array_distinct(F.concat(_grams(k), _grams(F.replace(k, F.lit(" "), F.lit("")))))


def row_grams(*fields: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[trigrams(f) for f in fields])))


def gram_rows(df: DataFrame, ordinal: str, *fields: Column) -> DataFrame:
    return df.select(ordinal, F.explode(row_grams(*fields)).alias("gram"))


def postings(df: DataFrame, ordinal: str, *fields: Column, buckets: int = 64) -> DataFrame:
    """(gram, bucket, ordinals sorted) of the published index, whose format has one list a gram; see posting_blocks."""
    g = gram_rows(df, ordinal, *fields).groupBy("gram").agg(F.sort_array(F.collect_list(ordinal)).alias("ordinals"))
    return g.withColumn("bucket", fnv1a32(F.col("gram")) % buckets)


def posting_blocks(df: DataFrame, ordinal: str, *fields: Column, buckets: int = 64, block: int = 1 << 16) -> DataFrame:
    """(bucket, gram, block, ordinals sorted): a gram's list cut by ordinal ranges, so no row grows with the data."""
    rows = gram_rows(df, ordinal, *fields).withColumn("block", F.floor(F.col(ordinal) / block).cast("long"))
    g = rows.groupBy("gram", "block").agg(F.sort_array(F.collect_list(ordinal)).alias("ordinals"))
    return g.select((fnv1a32(F.col("gram")) % buckets).alias("bucket"), "gram", "block", "ordinals")


def _wanted(query: str) -> tuple[str, list[str]]:
    q = re.sub("[^a-z0-9]+", " ", query.lower()).strip()
    return q, sorted({q[i : i + 3] for i in range(len(q) - 2)})


def search(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Rows with a field whose normal form contains the query's, in one scan; under 3 characters nothing matches."""
    q, _ = _wanted(query)
    if len(q) < 3:
        return df.where(F.lit(False))
    return df.where(text.any_of([text.search_key(F.col(f)).contains(q) for f in fields]))


def search_postings(blocks: DataFrame, details: DataFrame, ordinal: str, fields: list[str], query: str, buckets: int = 64) -> DataFrame:
    """The same from a stored index: only the buckets of the query's grams are read, then the candidates' details."""
    q, grams = _wanted(query)
    if len(q) < 3:
        return details.where(F.lit(False))
    of = sorted({_bucket(g) % buckets for g in grams})
    hits = blocks.where(F.col("bucket").isin(of) & F.col("gram").isin(grams))
    ids = hits.select("gram", F.explode("ordinals").alias(ordinal)).groupBy(ordinal).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(grams))
    return search(details.join(ids.select(ordinal), ordinal, "left_semi"), fields, query)


def _bucket(gram: str) -> int:
    h = 2166136261
    for unit in memoryview(gram.encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


def facet_search(spellings: DataFrame, label: str, query: str) -> DataFrame:
    """Spellings of the full vocabulary that contain the words (the picker's shorter list plays no part)."""
    q = re.sub("[^a-z0-9]+", " ", query.lower()).strip()
    return spellings.where(text.search_key(F.col(label)).contains(q)) if q else spellings.where(F.lit(False))


@dataclass
class Clause:
    """A condition on a field; `picked` facet keys, if any, are resolved by their record sets."""

    field: str
    op: str
    value: str
    picked: tuple[str, ...] = ()


@dataclass
class Query:
    text: str = ""
    clauses: list[Clause] = field(default_factory=list)
    year_min: int | None = None
    year_max: int | None = None
    source: str = field(default="", compare=False)  # as typed
    fields: dict[str, str] | None = field(default=None, compare=False)  # short forms

    def over(self, columns: list[str]) -> Query:
        """The query over a table: a namespace that names none of its columns is free text, where it stands."""
        if all(c.field in columns for c in self.clauses):
            return self
        if not self.source:
            raise ValueError(f"no column for {[c.field for c in self.clauses if c.field not in columns]}")
        return parse_query(self.source, self.fields, columns)


_TOKEN = re.compile(r'(?<!\S)(-?)([A-Za-z][A-Za-z_-]*):(?:"([^"]*)"|(\S+))')


def parse_query(q: str, fields: dict[str, str] | None = None, known: list[str] | None = None) -> Query:
    """ns:"value", -ns:value, from:YYYY, to:YYYY and free text.

    A namespace is a field's name (hyphens stand for underscores) or a short
    form of it in `fields`.  With `known`, other words before a colon (http://x, foo:bar)
    are free text; so is a year that is negated or no number, always.
    """
    short = QUERY_FIELDS | (fields or {})
    out, rest, at = Query(source=q, fields=fields), [], 0
    for m in _TOKEN.finditer(q):
        name, value = m[2].lower(), m[3] if m[3] is not None else m[4]
        column, year = short.get(name, name.replace("-", "_")), name in ("from", "to")
        if year and (m[1] or not value.isdigit()) or not year and known is not None and column not in known:
            continue  # stays in the text between clauses
        rest.append(q[at : m.start()])
        at = m.end()
        if year:
            setattr(out, "year_min" if name == "from" else "year_max", int(value))
        else:
            out.clauses.append(Clause(column, "not_contains" if m[1] else "contains", value))
    out.text = " ".join(" ".join([*rest, q[at:]]).split())
    return out


def is_compact(c: Clause, fields: tuple[str, ...]) -> bool:
    """Whether the clause can be tested on the row itself; picked facets are tested by membership."""
    return c.field in fields and not c.picked


def clause_column(c: Clause, df: DataFrame | None = None) -> Column:
    """The clause on a field; of several values one must match (for not_contains, all)."""

    def one(value: Column) -> Column:
        if c.field.endswith("case_number") and c.op == "exact":
            return text.strict_record_key(value) == re.sub("[^A-Z0-9]", "", c.value.upper())
        return text.text_op(value, c.op, c.value)

    if df is not None and dict(df.dtypes)[c.field].startswith("array"):
        values = F.coalesce(F.col(c.field), F.array().cast(dict(df.dtypes)[c.field]))
        return F.forall(values, one) if c.op == "not_contains" else F.exists(values, one)
    return one(F.col(c.field))


def picked_member(c: Clause, record: str, facet_rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Records of `universe` that the picked facets admit (exact) or leave (not_contains)."""
    how = "left_anti" if c.op == "not_contains" else "left_semi"
    return universe.join(members(facet_rows, list(c.picked), record), record, how)


def in_years(df: DataFrame, query: Query, prefixes: list[str] | None = None) -> DataFrame:
    """Prefix and year conditions on the partition columns, so that a partitioned table is pruned."""
    if prefixes:
        df = df.where(F.col("prefix").isin(prefixes))
    if query.year_min is not None:
        df = df.where(F.col("year") >= query.year_min)
    if query.year_max is not None:
        df = df.where(F.col("year") <= query.year_max)
    return df


def has_text(df: DataFrame, words: str, fields: list[str] | None = None) -> Column:
    """Whether a text column (or one of `fields`) contains the free text, ignoring case."""
    fields = [n for n, t in df.dtypes if t == "string"] if fields is None else fields
    return text.any_of([text.text_op(F.col(f), "contains", words) for f in fields])


def directory(df: DataFrame, query: Query, join: str = "and", fields: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Years and prefixes first, then the free text, then the clauses joined by and/or."""
    query = query.over(df.columns)
    df = in_years(df, query, prefixes)
    if query.text:
        df = df.where(has_text(df, query.text, fields))
    if not query.clauses:
        return df
    merge = (lambda a, b: a & b) if join == "and" else (lambda a, b: a | b)
    return df.where(reduce(merge, [clause_column(c, df) for c in query.clauses]))


def filter_directory(df: DataFrame, query: Query, record: str, order: list[Column], cap: int, excluded: DataFrame | None = None, join: str = "and", fields: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """directory() without the `excluded` records, capped with `overflow`; everything narrows before the cap."""
    out = directory(df, query, join, fields, prefixes)
    if excluded is not None:
        out = out.join(excluded.select(record).distinct(), record, "left_anti")
    return capped(out, order, cap)


def any_branch(df: DataFrame, query: Query, record: str, positive: list[DataFrame], negative: list[DataFrame], fields: list[str] | None = None) -> DataFrame:
    """OR of clauses, facet sets and negated facet sets, inside the query's years and free text.

    The negated sets make one branch, the complement of their intersection.
    """
    query = query.over(df.columns)
    base = in_years(df, query)
    if query.text:
        base = base.where(has_text(base, query.text, fields))
    branches = [base.join(p.select(record).distinct(), record, "left_semi") for p in positive]
    if query.clauses:
        branches.append(base.where(reduce(lambda a, b: a | b, [clause_column(c, base) for c in query.clauses])))
    if negative:
        branches.append(without(base, [n.select(record) for n in negative], record, "or"))
    if not branches:
        return base
    ids = reduce(lambda a, b: a.union(b), [x.select(record) for x in branches]).distinct()
    return base.join(ids, record, "left_semi")


def members(facet_rows: DataFrame, keys: list[str], record: str) -> DataFrame:
    """Distinct records of any of the facet keys."""
    return facet_rows.where(F.col("facet_key").isin(keys)).select(record).distinct()


def without(universe: DataFrame, sets: list[DataFrame], record: str, join: str = "and") -> DataFrame:
    """NOT a AND NOT b leaves out the union, NOT a OR NOT b the intersection."""
    if join == "and":
        out = reduce(lambda a, b: a.union(b), sets)
    else:
        out = reduce(lambda a, b: a.intersect(b), sets)
    return universe.join(out.distinct(), record, "left_anti")


def guarded(names: DataFrame, ceiling: int = 2000) -> DataFrame:
    """The names, or an error where more than `ceiling` match."""
    if names.limit(ceiling + 1).count() > ceiling:
        raise ValueError(f"more than {ceiling} names match")
    return names
