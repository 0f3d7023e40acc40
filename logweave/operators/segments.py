"""Segments: cutting, positions, checksums, manifests and replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.cyclic import MIN_SEQID, cyclic_distance, seqid_at
from logweave.operators.greedy import greedy_pack
from logweave.operators.scan import ROW_SPAN, Scan, block_of, prefix_scan

# Fixed values of the segment layout.
HEAD_BYTES = 4
FORMAT_FRAME_BYTES = 116
HEADER_BYTES = HEAD_BYTES + FORMAT_FRAME_BYTES
ROTATE_FRAME_BYTES = 31
SEGMENT_NAME_PATTERN = r"^binlog-[0-9]+.log$"
SEGMENT_NAME_PREFIX = "binlog-"
SEGMENT_NAME_SUFFIX = ".log"


def segment_name(number: Column) -> Column:
    return F.concat(F.lit(SEGMENT_NAME_PREFIX), number.cast("string"), F.lit(SEGMENT_NAME_SUFFIX))


def segment_number(name: Column) -> Column:
    return F.regexp_extract(name, "([0-9]+)", 1).cast("bigint")


def segments_matching(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose file name is a segment's, with its number."""
    return df.where(F.col(name).rlike(SEGMENT_NAME_PATTERN)).withColumn("segment_number", segment_number(F.col(name)))


def newest_and_oldest(df: DataFrame, name: str = "name") -> DataFrame:
    """The segment to append to (highest number) and the one a new reader starts with (lowest)."""
    named = segments_matching(df, name)
    return named.agg(F.max_by(name, "segment_number").alias("newest"), F.min_by(name, "segment_number").alias("oldest"))


def segment_log(
    records: DataFrame,
    limit: int,
    order: str = "seqid",
    size: str = "bytes",
    committed: str = "committed",
    scope: Sequence[str] = (),
    span: int = ROW_SPAN,
    start: int | None = None,
) -> DataFrame:
    """Add ``segment_id``: a new segment starts once the file is over ``limit`` bytes and the record just
    written ended a transaction. With ``start``, ``order`` holds ids of the cycle and the log begins at that
    one, so an id after the wrap follows those before it."""
    if start is not None:
        ahead = records.withColumn("__ahead", cyclic_distance(F.col(order), start))
        return segment_log(ahead, limit, "__ahead", size, committed, scope, span).drop("__ahead")
    scope = list(scope)
    narrow = records.select(*scope, order, F.col(size).cast("bigint").alias("__bytes"), F.col(committed).alias("__committed"))
    # 0, but no literal: Spark takes a constant out of the join's keys, and rows dealt by it would be dealt again
    narrow = narrow.withColumns({"__log": F.col(order) % 1, "__block": block_of(F.col(order), span)})
    cut = greedy_pack(
        narrow,
        scope or ["__log"],
        ["__block"],
        [order],
        "__bytes",
        max_size=limit,
        eligible="__committed",
        base_size=HEADER_BYTES,
        levels=2,  # one log holds everything
    )
    # payload, if any, meets its segment here and stays out of the cutting
    return records.join(cut.select(*scope, order, F.col("part").alias("segment_id")), [*scope, order])


def rewrite_positions(
    frames: DataFrame, order: Sequence[str], block: Column, scope: Sequence[str] = ("segment_id",), size: str = "size", frame: str | None = "frame"
) -> DataFrame:
    """Add ``log_pos``, the end byte of each frame in its segment, and ``crc`` of the frame."""
    placed = prefix_scan(
        frames.withColumn("__block", block),
        scope,
        [["__block"]],
        order,
        [Scan("log_pos", F.col(size).cast("bigint"), inclusive=True)],
    ).withColumn("log_pos", F.col("log_pos") + HEADER_BYTES)
    placed = placed.drop("__block")
    return placed if frame is None else placed.withColumn("crc", F.crc32(frame))


def segment_manifest(frames: DataFrame, scope: Sequence[str] = (), start: int = MIN_SEQID) -> DataFrame:
    """One row per segment: extent, times, size with header and rotation frame, and the next segment.

    First and last id go by their distance from ``start``, the id the log begins with, so a segment
    may hold the wrap of the cycle.
    """
    scope = list(scope)
    ahead = cyclic_distance(F.col("seqid"), start)
    per_segment = frames.groupBy(*scope, "segment_id").agg(
        F.count("*").alias("frames"),
        F.sum("size").alias("bytes"),
        seqid_at(start, F.min(ahead)).alias("first_seqid"),
        seqid_at(start, F.max(ahead)).alias("last_seqid"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )
    # "next" is the latest one seen when running over the numbers downwards
    backwards = per_segment.withColumns(
        {"__down": -F.col("segment_id"), "__block": block_of(-F.col("segment_id"), ROW_SPAN)}
    )
    chained = prefix_scan(
        backwards, scope, [["__block"]], ["__down"], [Scan("next_segment", F.col("segment_id"), "last")]
    ).drop("__down", "__block")
    rotation = F.when(
        F.col("next_segment").isNotNull(), ROTATE_FRAME_BYTES + F.length(segment_name(F.col("next_segment")))
    ).otherwise(0)
    return chained.withColumn("file_bytes", F.lit(HEADER_BYTES) + F.col("bytes") + rotation)


def _intact(frame: str, crc: str) -> Column:
    return F.coalesce(F.crc32(frame) == F.col(crc), F.lit(False))


def verify_segments(frames: DataFrame, scope: Sequence[str] = ("segment_id",), frame: str = "frame", crc: str = "crc") -> DataFrame:
    """Per segment the end of its longest intact prefix and why it ends: eof or checksum."""
    bad_start = F.when(~_intact(frame, crc), F.col("log_pos") - F.col("size"))
    return frames.groupBy(*scope).agg(
        F.coalesce(F.min(bad_start), F.max("log_pos")).alias("valid_end"),
        F.when(F.min(bad_start).isNull(), "eof").otherwise("checksum").alias("stop_reason"),
    )


def check_on_read(frames: DataFrame, frame: str = "frame", crc: str = "crc") -> DataFrame:
    """Frames as they are; reading a damaged one fails the query."""
    error = F.concat(F.lit("checksum failed at "), F.col("segment_id").cast("string"), F.lit(":"), F.col("log_pos").cast("string"))
    return frames.withColumn(frame, F.when(_intact(frame, crc), F.col(frame)).otherwise(F.raise_error(error).cast("binary")))


def quarantine(frames: DataFrame, frame: str = "frame", crc: str = "crc") -> tuple[DataFrame, DataFrame]:
    """(intact, damaged) frames."""
    return frames.where(_intact(frame, crc)), frames.where(~_intact(frame, crc))


def scan_segments(frames: DataFrame, start_segment: int | None = None, start_pos: int = HEAD_BYTES) -> DataFrame:
    """Frames from (segment, position) on, in order across segments.

    No segment means the oldest; a position inside the head means the start of the segment. The
    order is by ranges, so one long segment may spread over tasks.
    """
    if start_segment is None:
        wanted = frames
    else:
        pos = max(start_pos, HEAD_BYTES)
        begin = F.col("log_pos") - F.col("size")
        wanted = frames.where(
            (F.col("segment_id") > start_segment) | ((F.col("segment_id") == start_segment) & (begin >= pos))
        )
    return wanted.repartitionByRange("segment_id", "log_pos").sortWithinPartitions("segment_id", "log_pos")


def replay_from(frames: DataFrame, start_segment: int | None = None, start_pos: int = HEAD_BYTES) -> DataFrame:
    """What a consumer that stands at (segment, position) still has to apply, checked on the way."""
    return check_on_read(scan_segments(frames, start_segment, start_pos))
