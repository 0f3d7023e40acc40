"""Running aggregates over one long order without ever putting that order into one task.

``prefix_scan`` cuts the order into consecutive blocks whose keys are plain column expressions. Rows
meet only inside their block; blocks are summed up to one row each, scanned the same way one level up,
and joined back on the block key. Nothing is sampled and no partition number is used, so recomputing
a lost task gives the same blocks again. The join has no hint: block totals and rows share the block
key, and Spark broadcasts the totals only when their measured size is below its threshold.

Block totals are written once, before the rows are scanned, and count them: rows are dealt to so many tasks that
each sorts about ``ROWS_PER_TASK``, whatever number of shuffle partitions the session has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.integers import floor_div
from logweave.session import cut_lineage

# Positions per block. Positions are unique, so a block never has more rows than its span.
# Byte positions: 64 MiB of log and one event at most; the smallest event has 19 bytes.
BLOCK_SPAN = 1 << 26
# Row numbers, offsets and ids: about a million rows.
ROW_SPAN = 1 << 20
# Rows that one task sorts at once; a block is never split, so it holds one block at least.
ROWS_PER_TASK = 1 << 19


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is "sum", "max" or "last" (latest non-null)."""

    name: str
    value: Column
    kind: str = "sum"
    inclusive: bool = False
    default: object = None


def block_of(position: Column, span: int = BLOCK_SPAN) -> Column:
    return floor_div(position, span) if span > 1 else position


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of ``rows`` rows at most, dealt by ``keys`` to so many tasks that each gets about ``ROWS_PER_TASK``.

    A fixed number of partitions would let a task's memory grow with the table. What fits into one task is left as it is.
    """
    needed = -(-rows // ROWS_PER_TASK)
    if needed <= 1 or not keys:
        return df
    return df.repartition(max(needed, df.sparkSession.sparkContext.defaultParallelism), *keys)


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _running(scan: Scan, column: str, window, inclusive: bool) -> Column:
    frame = window.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    if scan.kind == "sum":
        return F.coalesce(F.sum(column).over(frame), F.lit(0))
    if scan.kind == "max":
        return F.max(column).over(frame)
    return F.last(column, ignorenulls=True).over(frame)


def _total(scan: Scan, column: str, order: Sequence[str]) -> Column:
    if scan.kind == "sum":
        return F.sum(column)
    if scan.kind == "max":
        return F.max(column)
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), _order_key(order)))


def _combine(scan: Scan, before: Column, local: Column) -> Column:
    if scan.kind == "sum":
        combined = F.coalesce(before, F.lit(0)) + local
    elif scan.kind == "max":
        combined = F.greatest(before, local)
    else:
        combined = F.coalesce(local, before)
    return combined if scan.default is None else F.coalesce(combined, F.lit(scan.default))


def prefix_scan(
    df: DataFrame,
    scope: Sequence[str],
    levels: Sequence[Sequence[str]],
    order: Sequence[str],
    scans: Sequence[Scan],
) -> DataFrame:
    """Add one running value per :class:`Scan` to ``df``.

    scope   independent orders (e.g. one per source); may be empty.
    levels  block columns from coarse to fine. ``scope + levels + order`` must be the total order, so
            each level continues the order of the one before; the finest level bounds the rows that
            meet in one task. Block columns must not be null.
    order   order of the rows inside the finest block.
    """
    return counted_scan(df, scope, levels, order, scans)[0]


def counted_scan(
    df: DataFrame, scope: Sequence[str], levels: Sequence[Sequence[str]], order: Sequence[str], scans: Sequence[Scan]
) -> tuple[DataFrame, int]:
    """:func:`prefix_scan` and the number of rows, for the steps that follow. There is one level at least."""
    temp = {s.name: f"__{s.name}" for s in scans}
    df = df.withColumns({temp[s.name]: s.value for s in scans})
    scanned, rows = _scan(df, list(scope), [list(x) for x in levels], list(order), scans, temp)
    return scanned.drop(*temp.values()), rows


def _scan(df, scope, levels, order, scans, temp, rows=0) -> tuple[DataFrame, int]:
    block = scope + [c for level in levels for c in level]
    if levels:
        kept = [_total(s, temp[s.name], order).alias(temp[s.name]) for s in scans]
        totals = cut_lineage(df.groupBy(*block).agg(*kept, F.count("*").alias("__rows")))
        blocks, rows = totals.agg(F.count("*"), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    window = W.partitionBy(*block).orderBy(*order) if block else W.orderBy(*order)
    local = spread(df, block, rows).withColumns({s.name: _running(s, temp[s.name], window, s.inclusive) for s in scans})
    if not levels:
        return local.withColumns({s.name: _combine(s, F.lit(None), F.col(s.name)) for s in scans}), rows

    upper = [Scan(f"__before_{s.name}", F.col(temp[s.name]), s.kind) for s in scans]
    names = {u.name: temp[s.name] for u, s in zip(upper, scans)}
    before, _ = _scan(totals.drop("__rows"), scope, levels[:-1], levels[-1], upper, names, blocks)
    joined = local.join(before.select(*block, *[u.name for u in upper]), block)
    combined = {s.name: _combine(s, F.col(u.name), F.col(s.name)) for s, u in zip(scans, upper)}
    return joined.withColumns(combined).drop(*[u.name for u in upper]), rows


def dense_rank_rows(df: DataFrame, scope, levels, order, name: str = "rn") -> DataFrame:
    """1-based row number along a long order."""
    return prefix_scan(df, scope, levels, order, [Scan(name, F.lit(1).cast("bigint"), inclusive=True)])
