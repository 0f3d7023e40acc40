"""Joins against settings and bookkeeping, which are small as a rule but not by law."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table with few rows per key set, such as one row per source or partition.

    ``small`` is counted up to ``limit``; within it, it is broadcast and the big side, however skewed
    its keys are, stays where it is. Beyond it, it is an ordinary join that adaptive execution may split.
    """
    fits = small.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(small) if fits else small, list(keys), how)
