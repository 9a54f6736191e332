"""Vectors as whole numbers: what columns of numbers become before exact arithmetic, and numpy matrices from Arrow lists."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Entries are cut off at this size, so that they and their differences are 64-bit numbers.
LARGEST = 1 << 62
#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 53
#: Entries of a matrix that is worked on at a time.
CELLS = 1 << 20


def is_vector(vector: Column) -> Column:
    """Neither null nor with an entry that is null, infinite or no number."""
    entries = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of every entry; beyond LARGEST the product is cut off there."""
    least, most = F.lit(-float(LARGEST)), F.lit(float(LARGEST))
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(least, F.least(most, c * float(scale)))) + F.lit(shift).cast("bigint"))


def by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the lists of that length, their entries as a matrix), a bounded number of entries at a time."""
    ends = lists.offsets.to_numpy()
    values, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for d in np.unique(sizes).tolist():
        at, step = np.flatnonzero(sizes == d), max(1, CELLS // max(1, d))
        for i in range(0, len(at), step):
            some = at[i:i + step]
            yield d, some, values[ends[some][:, None] + np.arange(d)].reshape(len(some), d)


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower 32 bits, whose sums over many rows stay within 64 bits; value = upper * 2 ** 32 + lower."""
    return values >> 32, values & 0xFFFFFFFF


def bound(values: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(-int(values.min()), int(values.max()), 0) if values.size else 0
