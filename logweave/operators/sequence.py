"""Dense ids over all sources, and putting out-of-order messages back in id order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.cyclic import CYCLE, MAX_SEQID, MIN_SEQID, cyclic_distance, seqid_at
from logweave.functions.integers import floor_div
from logweave.functions.times import epoch_seconds
from logweave.operators.relay import message_scope
from logweave.operators.scan import BLOCK_SPAN, ROW_SPAN, Scan, block_of, dense_rank_rows, prefix_scan

SLOT_SECONDS = 60
SLOTS_PER_HOUR = 3600 // SLOT_SECONDS


def assign_seqid(
    records: DataFrame,
    start: int = MIN_SEQID,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """One dense id per record over all sources, ``start`` first, wrapping at the end of the cycle.

    Sources interleave by minute of their event time; inside a source the log order always holds, also
    where its clock steps back, because a record never sorts before an earlier minute of its source.
    """
    scope = list(scope)
    slotted = prefix_scan(
        records.withColumns(
            {
                "__block": block_of(F.col("log_pos"), span),
                "__minute": floor_div(epoch_seconds(F.col("event_ts")), SLOT_SECONDS),
            }
        ),
        scope,
        [["log_file", "__block"]],
        ["log_pos"],
        [Scan("__slot", F.col("__minute"), "max", inclusive=True)],
    ).withColumn("__hour", floor_div(F.col("__slot"), SLOTS_PER_HOUR))
    levels = [["__hour"], ["__slot", *scope, "log_file", "__block"]]
    ranked = dense_rank_rows(slotted, [], levels, ["log_pos"], "__rn")
    return ranked.withColumn("seqid", seqid_at(start, F.col("__rn") - 1)).drop(
        "__block", "__minute", "__slot", "__hour", "__rn"
    )


def fan_in(sources: Sequence[DataFrame], start: int = MIN_SEQID, scope: Sequence[str] = ("source_id",), span: int = BLOCK_SPAN) -> DataFrame:
    """Records of several logs under one counter."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other)
    return assign_seqid(merged, start, scope, span)


def order_within_source(events: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Events sorted by source and position. Ranges, not hashes, so a hot source spreads over tasks."""
    key = [*scope, "log_file", "log_pos"]
    return events.repartitionByRange(*key).sortWithinPartitions(*key)


def _valid(seqid: Column) -> Column:
    return seqid.isNotNull() & seqid.between(MIN_SEQID, MAX_SEQID)


def _ahead(seqid: Column, start: int) -> Column:
    """Expected id or later: at most half a cycle ahead."""
    return _valid(seqid) & (cyclic_distance(seqid, start) <= CYCLE // 2)


def ahead_of(messages: DataFrame, start: int) -> DataFrame:
    """Messages with the expected id or a later one, copies included."""
    return messages.where(_ahead(F.col("seqid"), start))


def _place(messages: DataFrame) -> list[str]:
    """What tells messages apart: rows that agree in it are copies of one message, delivered again."""
    return [*message_scope(messages), "offset"]


def _winners(messages: DataFrame, start: int) -> DataFrame:
    """(d, place): per id ahead of ``start`` the message with the lowest partition and offset, then topic.

    A grouped minimum, so copies of one id are folded before they are shuffled.
    """
    lowest = F.struct("partition", "offset", *[c for c in _place(messages) if c not in ("partition", "offset")])
    return (
        ahead_of(messages, start)
        .groupBy(cyclic_distance(F.col("seqid"), start).alias("d"))
        .agg(F.min(lowest).alias("at"))
        .select("d", "at.*")
    )


def _ranked(messages: DataFrame, start: int, span: int) -> DataFrame:
    """Winners with ``released``: no id between ``start`` and theirs is missing."""
    blocks = _winners(messages, start).withColumn("__block", block_of(F.col("d"), span))
    ranked = dense_rank_rows(blocks, [], [["__block"]], ["d"], "__rn")
    return ranked.select("d", *_place(messages), (F.col("__rn") - 1 == F.col("d")).alias("released"))


def drop_stale(messages: DataFrame, start: int) -> DataFrame:
    """Messages at or ahead of the expected id, one row per id, also where a message was delivered twice."""
    place = _place(messages)
    return messages.join(_winners(messages, start).drop("d"), place, "left_semi").dropDuplicates(place)


def resequence(messages: DataFrame, start: int = MIN_SEQID, span: int = ROW_SPAN) -> DataFrame:
    """Messages that can go out now, with ``d`` as their order: from ``start`` up to the first gap, one row per id.

    Ids are decided on the id and the place (topic, partition, offset) alone; the payload is joined once, on its place. Several
    rows of one place are one message delivered again: one of them goes out. The join has brought them together already.
    """
    place = _place(messages)
    released = _ranked(messages, start, span).where("released").select("d", *place)
    return messages.join(released, place).dropDuplicates(place)


def message_status(messages: DataFrame, start: int, window: int, span: int = ROW_SPAN) -> DataFrame:
    """``status`` per message: released, pending (inside the window after the first gap), blocked (beyond
    it), duplicate (second copy, second delivery or behind the expected id) or invalid."""
    place = _place(messages)
    ranked = _ranked(messages, start, span)
    # released rows are exactly the distances 0 .. expected-1: one running maximum tells all others
    expected = F.coalesce(ranked.where("released").agg(F.max("d") + 1).scalar(), F.lit(0))
    marked = ranked.withColumn(
        "__status",
        F.when(F.col("released"), "released").when(F.col("d") - expected < window, "pending").otherwise("blocked"),
    ).select(*place, "__status")
    delivery = F.row_number().over(W.partitionBy(*place).orderBy("seqid"))
    status = F.when(~_valid(F.col("seqid")) | F.col("seqid").isNull(), "invalid").otherwise(
        F.when(F.col("__delivery") == 1, F.col("__status")).otherwise("duplicate")
    )
    told = messages.join(marked, place, "left").withColumn("__delivery", delivery)
    return told.withColumn("status", F.coalesce(status, F.lit("duplicate"))).drop("__status", "__delivery")


def gap_report(messages: DataFrame, start: int, span: int = ROW_SPAN) -> DataFrame:
    """Missing id ranges (first_missing, last_missing, missing) between the ids that arrived."""
    distances = (
        ahead_of(messages, start)
        .select(cyclic_distance(F.col("seqid"), start).alias("d"))
        .distinct()
        .withColumn("__block", block_of(F.col("d"), span))
    )
    before = prefix_scan(
        distances, [], [["__block"]], ["d"], [Scan("previous", F.col("d"), "max", default=-1)]
    )
    return before.where(F.col("d") - F.col("previous") > 1).select(
        seqid_at(start, F.col("previous") + 1).alias("first_missing"),
        seqid_at(start, F.col("d") - 1).alias("last_missing"),
        (F.col("d") - F.col("previous") - 1).alias("missing"),
    )
