"""Vectors as exact integers, in blocks of rows: what the operators on embeddings share."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a block of vectors.
BLOCK_BYTES = 2 << 20
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, infinite or not a number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def whole(vector: Column, unit: int = 256) -> Column:
    """Each entry, as a double, times ``unit``, rounded down to a long; beyond a long's range its nearest value."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * unit) + F.lit(0).cast("long"))


def stacked(column: pa.Array) -> np.ndarray:
    """A list column as rows of longs; shorter rows are filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    d = int(ends.max(initial=0))
    if len(ends) and (ends == d).all():
        return flat.reshape(len(ends), d)
    out = np.zeros((len(ends), d), np.int64)
    out[np.arange(d)[None, :] < ends[:, None]] = flat
    return out


def widened(x: np.ndarray, d: int) -> np.ndarray:
    """Rows filled up with zeros to ``d`` entries."""
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def runs(batches: Iterator[pa.RecordBatch], vector: str, entry_bytes: int = 8) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut into pieces of about BLOCK_BYTES of vectors, each with its vectors as an array."""
    for batch in batches:
        x = stacked(batch.column(batch.schema.get_field_index(vector)))
        step = max(1, BLOCK_BYTES // max(1, entry_bytes * x.shape[1]))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step), x[k : k + step]


def frozen(x: np.ndarray) -> bytes:
    """An array of longs as bytes, rows and columns first."""
    return struct.pack("<qq", *x.shape) + np.ascontiguousarray(x, "<i8").tobytes()


def thawed(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8", offset=16).reshape(struct.unpack_from("<qq", data))


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as an integer of any size."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two arrays of longs of equal width: floating-point where no sum can reach EXACT, else integers of any size, cut to a long."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    full = a.astype(object) @ b.astype(object).T
    return np.clip(full, -(1 << 63), (1 << 63) - 1).astype(np.int64)
