"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def likely_sampled(seed: int, want: int, total: Column | int, *key: str) -> Column:
    """Rows among which the `want` of smallest hash lie, but for a vanishing chance: the hash decides, at a rate of twice
    want / total. Tasks then send on a number of rows that doesn't grow with the input; whoever takes the first `want` of them by
    xxhash64(key, seed) has the sample."""
    order = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 34)
    total = F.lit(total) if isinstance(total, int) else total
    return order < F.ceil(F.least(F.lit(1.0), (2.0 * want + 100) / F.greatest(total, F.lit(1))) * _GRAIN)


def sample_order(seed: int, *key: str) -> Column:
    """The order in which likely_sampled() keeps the first rows."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 34)
