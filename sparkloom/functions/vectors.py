"""Vector arithmetic as column expressions over arrays, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def decay(hits: Column, days: Column, scale: float = 7.0, cap: int = 10) -> Column:
    """min(hits, cap) * exp(-days / scale)."""
    return F.least(hits, F.lit(cap)) * F.exp(-days / F.lit(scale))


def whole_days(since: Column, now: Column) -> Column:
    """Whole 24-hour blocks that have passed."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400)


def unit_rows(column: pa.Array, dim: int | None = None, zeros: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of an Arrow column of number lists: those of one length, without nulls, finite, not zero.

    The length is that of the first usable row if it isn't given. zeros: zero vectors are kept, as they are.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()  # without the items of null lists
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # nulls are NaN here
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    if not good.any():
        return np.zeros(0, np.int64), np.zeros((0, dim or 0))
    dim = dim or int(sizes[good][0])
    rows = np.flatnonzero(good & (sizes == dim))
    x = flat[(ends - sizes)[rows][:, None] + np.arange(dim)]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    kept = np.isfinite(norm) & (zeros | (norm > 0))
    return rows[kept], x[kept] / np.where(norm[kept] > 0, norm[kept], 1.0)[:, None]
