"""Bounded samples by a hash threshold that follows from counts, so that no task sorts or gathers the whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 62


def by_hash(share: Column | float, *key: str) -> Column:
    """Whether a row is among a share (0 to 1) of the hashes of its key; rows of one key go together."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - _BITS) < share * float(1 << _BITS)


def share_of(size: int, rows: int) -> float:
    """The share that gives about `size` of so many rows, with four deviations of the count to spare."""
    return min(1.0, (size + 4 * size**0.5) / max(rows, 1))
