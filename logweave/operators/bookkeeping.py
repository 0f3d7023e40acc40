"""Positions, offsets and watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.relay import message_scope
from logweave.operators.scan import ROW_SPAN, Scan, block_of, dense_rank_rows, prefix_scan


def last_position(records: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Where each source's last emitted record ended; events that were filtered out do not move it."""
    per_file = records.groupBy(*scope, "log_file").agg(F.max("log_pos").alias("log_pos"))  # plain numbers: hashed, not sorted
    return (
        per_file.groupBy(*scope)
        .agg(F.max(F.struct("log_file", "log_pos")).alias("at"))
        .select(*scope, "at.log_file", "at.log_pos")
    )


def last_offsets(processed: DataFrame, order: str = "ord") -> DataFrame:
    """Last processed (offset, seqid) per partition, of each topic where messages carry one; the last write wins."""
    return processed.groupBy(*message_scope(processed)).agg(
        F.max_by("offset", order).alias("offset"), F.max_by("seqid", order).alias("seqid")
    )


def offset_book(processed: DataFrame, order: str = "ord") -> DataFrame:
    """The same as one row (one per topic where messages carry one): map of partition to offset, and the last
    sequence id. There are as many entries as topic partitions."""
    scope = message_scope(processed)
    topic = [c for c in scope if c != "partition"]
    per_partition = processed.groupBy(*scope).agg(
        F.max_by("offset", order).alias("offset"), F.max(F.struct(order, "seqid")).alias("latest")
    )
    return per_partition.groupBy(*topic).agg(
        F.map_from_entries(F.collect_list(F.struct("partition", "offset"))).alias("offsets"),
        F.max("latest").alias("latest"),
    ).select(*topic, "offsets", F.col("latest.seqid").alias("seqid"))


def contiguous_watermark(done: DataFrame, start: Column | int = 0, span: int = ROW_SPAN) -> DataFrame:
    """Highest offset per partition (of each topic where messages carry one) up to which every offset since ``start`` is done.

    ``start`` may be a column that is constant per partition. Partitions whose start has not
    arrived have no row.
    """
    scope = message_scope(done)
    start = F.lit(start).cast("bigint") if isinstance(start, int) else start
    offsets = (
        done.select(*scope, "offset", start.alias("start"))
        .where(F.col("offset") >= F.col("start"))
        .groupBy(*scope, "offset")
        .agg(F.min("start").alias("start"))
        .withColumn("__block", block_of(F.col("offset"), span))
    )
    ranked = dense_rank_rows(offsets, scope, [["__block"]], ["offset"], "__rn")
    return (
        ranked.where(F.col("offset") - F.col("start") == F.col("__rn") - 1)
        .groupBy(*scope)
        .agg(F.max("offset").alias("watermark"))
    )


def offset_intervals(offsets: DataFrame, span: int = ROW_SPAN) -> DataFrame:
    """Runs of offsets without a hole: (topic, partition, low, high), from single offsets or from such runs.

    Runs that overlap or touch become one, so this is a union: runs of two batches may be united in any order, and a
    partition needs as many rows as it has holes.
    """
    scope = message_scope(offsets)
    if "offset" in offsets.columns:
        offsets = offsets.select(*scope, F.col("offset").alias("low"), F.col("offset").alias("high"))
    # the longest of the runs that begin at one offset stands for them
    runs = offsets.groupBy(*scope, "low").agg(F.max("high").alias("high")).withColumn("__block", block_of(F.col("low"), span))
    reached = prefix_scan(runs, scope, [["__block"]], ["low"], [Scan("__reached", F.col("high"), "max")])
    starts = F.coalesce(F.col("low") > F.col("__reached") + 1, F.lit(True)).cast("bigint")
    numbered = prefix_scan(reached, scope, [["__block"]], ["low"], [Scan("__run", starts, inclusive=True)])
    # within blocks first, where the rows are
    local = numbered.groupBy(*scope, "__block", "__run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return local.groupBy(*scope, "__run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("__run")


def watermark_of(intervals: DataFrame, start: int = 0) -> DataFrame:
    """:func:`contiguous_watermark` from :func:`offset_intervals`: the end of the run that holds ``start``."""
    holding = intervals.where((F.col("low") <= start) & (F.col("high") >= start))
    return holding.select(*message_scope(intervals), F.col("high").alias("watermark"))
