"""Bucket hashes and posting-list encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# 32-bit FNV-1a.
FNV_START, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a32(x: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as an unsigned long."""
    hexes = F.hex(F.encode(x, "UTF-16BE"))
    n = (F.length(hexes) / 4).cast("int")
    units = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(hexes.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    )
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
    return F.aggregate(units, F.lit(FNV_START).cast("bigint"), step)


def lookup_bucket(kind: str, key: Column, buckets: int) -> Column:
    return fnv1a32(F.concat(F.lit(f"{kind}:"), key)) % buckets


def sha_bucket(key: Column) -> Column:
    """First byte of the SHA-256 as two hex digits."""
    return F.substring(F.sha2(key, 256), 1, 2)


def bucket_name(i: Column, buckets: int) -> Column:
    width = max(2, len(f"{buckets - 1:x}"))
    return F.lpad(F.lower(F.hex(i.cast("long"))), width, "0")


def encode_differences(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """LEB128 of the differences of each run values[bounds[i] : bounds[i + 1]], which is positive and strictly rising."""
    first = bounds[:-1][np.diff(bounds) > 0]
    d = np.diff(values, prepend=0)
    d[first] = values[first]
    if len(d) and d.min() <= 0:
        raise ValueError("postings must be positive and strictly increasing")
    digits = np.stack([(d >> (7 * k)) for k in range(9)])  # a long below 2^63 has nine digits of seven bits
    size = np.maximum(1, (digits > 0).sum(0))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(9):
        on = size > k
        out[at[:-1][on] + k] = (digits[k][on] & 127) | np.where(size[on] > k + 1, 128, 0)
    raw, cut = out.tobytes(), at[bounds]
    return [raw[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]


def decode_differences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all runs, bounds of the runs among them) of bytes by encode_differences()."""
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends + 1])[: len(ends)]
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    d = np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins) if len(ends) else np.zeros(0, np.int64)
    own = np.searchsorted(ends, bounds)
    total = np.concatenate([[0], np.cumsum(d)])
    return total[1:] - np.repeat(total[own[:-1]], np.diff(own)), own


def delta_varints(lists: Column) -> Column:
    """Base64 of LEB128 differences of each strictly increasing list."""
    return arrow_udf(_packed, "string")(lists)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pa.compute.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _packed(lists: pa.Array) -> pa.Array:
    import base64

    missing = lists.is_null().to_pylist()
    return pa.array([None if m else base64.b64encode(x).decode() for m, x in zip(missing, encode_differences(*_lists(lists)))], pa.string())


def pack_differences(lists: Column) -> Column:
    """LEB128 differences of each strictly increasing list of positive longs, as bytes."""
    return arrow_udf(lambda x: pa.array(encode_differences(*_lists(x)), pa.binary()), "binary")(lists)


def unpack_differences(packed: Column) -> Column:
    """The lists of pack_differences()."""
    return arrow_udf(_unpacked, "array<bigint>")(packed)


def _unpacked(packed: pa.Array) -> pa.Array:
    raw = [x or b"" for x in packed.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    values, own = decode_differences(np.frombuffer(b"".join(raw), np.uint8), bounds)
    return pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(values))


def undo_delta_varints(text: str) -> list[int]:
    """The list of one text of delta_varints()."""
    import base64

    data = np.frombuffer(base64.b64decode(text), np.uint8)
    return decode_differences(data, np.array([0, len(data)]))[0].tolist()
