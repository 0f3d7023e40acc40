"""Cutting a log piece by piece: each piece follows on what the pieces before it left.

What routing and cutting must know of all earlier events of a source is one row: how far it was read, how many
transactions were committed, whether one is open and what its latest table map decided, which part
of it is open and how many bytes that holds. The row enters the next piece as one event at the
position read last: a statement that puts routing into the same state and weighs as much as the open part. So scan and cut
see each event once, in the piece that brings it, however long its transaction stays open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.rules import BEGIN_QUERY, COMMIT, OTHER_QUERY, OTHER_TABLE, WANTED_TABLE, route_marked
from logweave.operators.scan import BLOCK_SPAN
from logweave.operators.small import join_small
from logweave.operators.transactions import Rules, headers_of, marked_events, parts_of_routed, position

STATE = "log_file string, log_pos bigint, epoch bigint, in_tx boolean, keep boolean, part bigint, held_bytes bigint"


def no_state(events: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """The state before the first piece: no row for any source."""
    spark = events.sparkSession
    return spark.createDataFrame([], events.select(*scope).schema).select(
        *scope, *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in STATE.split(", "))]
    )


def routed_after(
    events: DataFrame, state: DataFrame, rules: Rules, scope: Sequence[str] = ("source_id",), span: int = BLOCK_SPAN
) -> DataFrame:
    """New events with the epoch, state and action they have in the whole log. The row that stands for
    ``state`` stays among them, at the position read last."""
    scope = list(scope)
    marked = marked_events(events, rules, scope)
    mark = F.when(F.col("keep"), WANTED_TABLE).when(F.col("in_tx"), BEGIN_QUERY).otherwise(OTHER_QUERY)
    before = state.select(
        *scope,
        "log_file",
        "log_pos",
        F.lit(None).cast(marked.schema["event_ts"].dataType).alias("event_ts"),
        F.col("held_bytes").cast(marked.schema["size"].dataType).alias("size"),
        mark.cast("tinyint").alias("mark"),
    )
    return route_marked(marked.unionByName(before), scope, span)


def parts_after(routed: DataFrame, state: DataFrame, max_size: int, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """``record_parts`` of the new events of :func:`routed_after`, under the keys they have in the whole log."""
    scope = list(scope)
    before = state.select(*scope, position().alias("read"), F.col("epoch").alias("epoch_before"), F.col("part").alias("part_before"))
    parts = join_small(parts_of_routed(routed, max_size, scope), before, scope)
    follows = (F.col("epoch") == 0) & (F.col("part") >= 0)
    parts = parts.withColumn("part", F.when(follows, F.col("part") + F.coalesce("part_before", F.lit(0))).otherwise(F.col("part")))
    parts = parts.withColumn("epoch", F.col("epoch") + F.coalesce("epoch_before", F.lit(0)))
    new = F.col("read").isNull() | (position() > F.col("read"))
    return parts.where(new).drop("read", "epoch_before", "part_before")


def state_after(routed: DataFrame, parts: DataFrame, state: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """The state after the piece. ``parts``: all parts that are not out yet, those of earlier pieces included."""
    scope = list(scope)
    mark = F.col("mark")
    by_file = routed.groupBy(*scope, "epoch", "log_file").agg(
        F.max("log_pos").alias("log_pos"),
        F.bool_or(mark == COMMIT).alias("closed"),
        F.bool_or(mark.isin(BEGIN_QUERY, WANTED_TABLE)).alias("opened"),
        F.max_by(mark == WANTED_TABLE, F.when(mark.isin(WANTED_TABLE, OTHER_TABLE), F.col("log_pos"))).alias("kept"),
    )
    ends = by_file.groupBy(*scope, "epoch").agg(
        F.max(position()).alias("read"),
        F.bool_or("closed").alias("closed"),
        F.bool_or("opened").alias("opened"),
        F.max_by("kept", F.when(F.col("kept").isNotNull(), F.col("log_file"))).alias("kept"),
    )
    last = ends.groupBy(*scope).agg(F.max("epoch").alias("epoch"), F.max("read").alias("read"), F.max_by(F.struct("closed", "opened", "kept"), "epoch").alias("end"))
    open_ = ~F.col("end.closed")
    earlier = state.select(*scope, F.col("epoch").alias("epoch_before"), F.col("part").alias("part_before"))
    last = join_small(last, earlier, scope).select(
        *scope,
        "read.log_file",
        "read.log_pos",
        (F.col("epoch") + F.coalesce("epoch_before", F.lit(0)) + F.col("end.closed").cast("bigint")).alias("epoch"),
        (open_ & F.col("end.opened")).alias("in_tx"),
        (open_ & F.coalesce("end.kept", F.lit(False))).alias("keep"),
        F.when(open_ & (F.col("epoch") == 0), F.coalesce("part_before", F.lit(0))).otherwise(0).alias("part_before"),
    )
    held = parts.where("part >= 0").groupBy(*scope, "epoch", "part").agg(F.sum("size").alias("bytes"), F.bool_or("is_cut").alias("cut"))
    newest = held.groupBy(*scope, "epoch").agg(F.max(F.struct("part", "cut", "bytes")).alias("at"))
    part = F.coalesce(F.col("at.part") + F.col("at.cut").cast("bigint"), F.col("part_before"))
    held_bytes = F.when(F.col("at.cut"), 0).otherwise(F.coalesce("at.bytes", F.lit(0)))
    named = last.join(newest, [*scope, "epoch"], "left")
    return named.select(*scope, "log_file", "log_pos", "epoch", "in_tx", "keep", part.alias("part"), held_bytes.cast("bigint").alias("held_bytes"))


def held_parts(parts: DataFrame, state: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Of the parts that were not out before the piece those that still aren't: the open part of each source."""
    scope = list(scope)
    open_ = state.where("held_bytes > 0").select(*scope, "epoch", "part")
    return join_small(parts, open_, [*scope, "epoch", "part"], "left_semi")


def headers_after(held: DataFrame, parts: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Headers of the records that the piece completes."""
    return headers_of(held.unionByName(parts), scope)
