"""Sequence ids live on the cycle [MIN_SEQID .. MAX_SEQID] and are compared by distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_SEQID = 1
MAX_SEQID = 10**12

CYCLE = MAX_SEQID - MIN_SEQID + 1


def cyclic_distance(seqid: Column, start: Column | int) -> Column:
    """Steps from ``start`` forward to ``seqid``; more than half a cycle means "behind"."""
    start = F.lit(start).cast("bigint") if isinstance(start, int) else start
    return F.pmod(seqid - start, F.lit(CYCLE))


def seqid_at(start: Column | int, steps: Column) -> Column:
    """The id ``steps`` after ``start``."""
    start = F.lit(start).cast("bigint") if isinstance(start, int) else start
    return F.pmod(start - F.lit(MIN_SEQID) + steps, F.lit(CYCLE)) + F.lit(MIN_SEQID)


def next_seqid(seqid: int, steps: int = 1) -> int:
    """Driver-side form of :func:`seqid_at` for a single counter value."""
    return (seqid - MIN_SEQID + steps) % CYCLE + MIN_SEQID
