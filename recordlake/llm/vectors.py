"""Embedding columns as NumPy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import make_importable, quoted, session

SCALE = 1024
#: Scaled components stay below this, so that squared distances of a thousand components fit in a long.
LIMIT = 1 << 26


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def kept(table: DataFrame, id_col: str, vector: str, dims: int | None) -> DataFrame:
    """(id, v) of the usable vectors, of `dims` components where that is given."""
    make_importable(session(table))
    v = F.col(quoted(vector))
    ok = usable(v) if dims is None else usable(v) & (F.size(v) == dims)
    return table.where(ok).select(F.col(quoted(id_col)).alias("id"), v.alias("v"))


def scaled(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 * x) of every component, a row for each vector; components are taken as doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    out = np.floor(SCALE * x)
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT // SCALE} or more in size: its squared distances need not fit in a long")
    return out.astype(np.int64)


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, scaled vectors) of every batch with rows."""
    for b in batches:
        if b.num_rows:
            yield b.column(0), scaled(b.column(1), dims)
