"""Sums that tasks have made, merged a few at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def fold_states(scratch: Scratch, states: DataFrame, fold: Callable[[list[dict]], dict], fan: int, name: str) -> dict | None:
    """One state of all rows of `states`, whose column `part` (from 0) numbers the tasks that made them.

    fold(states by rising part) gives one without `part`; no task and not the driver
    gets more than `fan` of them.  None without rows.
    """
    states = scratch.table(states, f"{name}_0")
    schema, (most, level) = states.schema, (states.agg(F.max("part")).first()[0] or 0, 0)

    def merge(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([{"part": rows[0]["part"] // fan, **fold(rows)}]).select(schema.names)

    while most >= fan:
        level += 1
        states = scratch.table(states.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, schema), f"{name}_{level}")
        most //= fan
    rows = sorted((r.asDict() for r in states.collect()), key=lambda r: r["part"])  # at most `fan`
    return fold(rows) if rows else None
