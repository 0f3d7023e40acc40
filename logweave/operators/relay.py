"""Packing messages for a hop and unpacking them on the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.cyclic import MAX_SEQID, MIN_SEQID
from logweave.functions.envelope import decode_envelope, decode_pack, encode_pack
from logweave.functions.integers import floor_div
from logweave.functions.times import epoch_seconds
from logweave.operators.greedy import greedy_pack
from logweave.operators.routing import topic_rows
from logweave.operators.scan import ROW_SPAN, Scan, block_of, counted_scan


def override_topic(default: str | None, topic: Column) -> Column:
    """A configured default topic wins when it is not empty."""
    return F.coalesce(F.nullif(F.lit(default).cast("string"), F.lit("")), topic)


def message_scope(messages: DataFrame) -> list[str]:
    """What an offset counts within: the partition, of its topic where messages carry one."""
    return [c for c in ("topic", "partition") if c in messages.columns]


def pack_parts(
    messages: DataFrame, max_count: int, max_size: int, tick_seconds: int, span: int = ROW_SPAN
) -> DataFrame:
    """Which pack every message goes into: (topic, partition, offset, bytes, tick, part), without payload.

    A pack closes once it holds more than ``max_size`` value bytes or more than ``max_count`` messages,
    or at a tick. Messages are taken in offset order, so the tick a message is seen in is never before
    that of an earlier offset.
    """
    scope = message_scope(messages)
    sized = messages.select(
        *scope,
        "offset",
        F.octet_length("value").cast("bigint").alias("bytes"),
        floor_div(epoch_seconds(F.col("ts")), tick_seconds).alias("ts_tick"),
        block_of(F.col("offset"), span).alias("block"),
    )
    ticked, rows = counted_scan(
        sized, scope, [["block"]], ["offset"], [Scan("tick", F.col("ts_tick"), "max", inclusive=True)]
    )
    return greedy_pack(
        ticked.drop("ts_tick"),
        scope,
        ["block"],
        ["offset"],
        "bytes",
        max_size=max_size,
        max_count=max_count,
        run="tick",
        rows=rows,
    ).drop("block", "is_cut")


def pack_messages(
    messages: DataFrame,
    max_count: int,
    max_size: int,
    tick_seconds: int,
    topic: str | None = None,
    span: int = ROW_SPAN,
) -> DataFrame:
    """Packs as JSON with their extent. The payload joins its pack number on its offset and never enters
    Python; a pack is bounded by its limits, and never mixes topics, even if all go out under one name."""
    parts = pack_parts(messages, max_count, max_size, tick_seconds, span)
    scope = message_scope(messages)
    named = messages.select(*scope, "offset", override_topic(topic, F.col("topic")).alias("__topic"), "key", "value")
    data = F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "key", "value"))),
        lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value")),
    )
    return (
        named.join(parts, [*scope, "offset"])
        .groupBy(*scope, "__topic", "tick", "part")
        .agg(
            F.count("*").alias("messages"),
            F.sum("bytes").alias("bytes"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
            data.alias("data"),
        )
        .withColumn("topic", F.col("__topic"))
        .withColumn("pack", encode_pack(F.col("topic"), F.col("data")))
        .drop("data", "__topic")
    )


def unpack(packs: DataFrame, pack: str = "pack", keep: Sequence[str] = ()) -> DataFrame:
    """(topic, idx, key, value) of every message in every pack."""
    return packs.select(*keep, decode_pack(F.col(pack)).alias("p")).select(
        *keep, F.col("p.topic").alias("topic"), F.posexplode("p.data").alias("idx", "m")
    ).select(*keep, "topic", "idx", "m.key", "m.value")


def republish(packs: DataFrame, partitions: int, pack: str = "pack", keep: Sequence[str] = ()) -> DataFrame:
    """Topic rows of unpacked messages under their own keys and topic."""
    rows = unpack(packs, pack, keep)
    return topic_rows(rows, F.col("topic"), F.col("value"), partitions, F.col("key"), keep)


def decode_messages(messages: DataFrame) -> DataFrame:
    """Messages with ``seqid`` and ``data`` from their envelope; undecodable ones have a null seqid."""
    # a generator of one row, so that filters on its columns do not parse the JSON again below it
    return messages.select("*", F.inline(F.array(decode_envelope(F.col("value")))))


def split_bad_envelopes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): envelopes without a usable id or data never reach the re-sequencer."""
    decoded = decode_messages(messages)
    usable = F.coalesce(F.col("seqid").between(MIN_SEQID, MAX_SEQID) & F.col("data").isNotNull(), F.lit(False))
    return decoded.where(usable), decoded.where(~usable).drop("seqid", "data")
