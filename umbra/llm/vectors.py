"""Tables of embeddings as whole numbers, and numpy views of their Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def whole(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of each component, kept within -most to most."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-4.0 * most), F.least(F.lit(4.0 * most), x.cast("double") * scale))))).cast("int"))


def dimension(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 if there is none."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of int as rows of a matrix, int64; shorter ones are filled with 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), width), np.int64)
    if len(lists):
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if (sizes == width).all():
            return flat.astype(np.int64).reshape(len(lists), width)
        row = np.repeat(np.arange(len(lists)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def from_bytes(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """Binary values of one size as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def to_bytes(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    size = data.itemsize * data.shape[1]
    if not size:
        return pa.array([b""] * len(data), pa.binary())
    offsets = np.arange(0, (len(data) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
