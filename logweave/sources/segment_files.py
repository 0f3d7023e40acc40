"""Reading raw segment files: a head, then frames that carry their own length."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.segments import HEAD_BYTES, SEGMENT_NAME_PATTERN, segment_number

# Fixed format: little-endian header of ts, type, server id, size, end position, flags; CRC32 last.
FRAME_HEADER = "<IBIIIH"
FRAME_HEADER_BYTES = struct.calcsize(FRAME_HEADER)
CHECKSUM = "<I"
CHECKSUM_BYTES = struct.calcsize(CHECKSUM)

FRAME_SCHEMA = (
    "segment_file string, segment_id bigint, idx bigint, begin bigint, log_pos bigint, size bigint, "
    "event_ts bigint, type int, frame binary, crc bigint, crc_ok boolean, complete boolean"
)


def split_frames(content: bytes) -> Iterator[tuple]:
    """(begin, end, size, ts, type, body, crc, crc_ok, complete); a torn tail is one incomplete frame."""
    at = HEAD_BYTES
    while at < len(content):
        fits = at + FRAME_HEADER_BYTES <= len(content)
        ts, kind, _, size, _, _ = struct.unpack_from(FRAME_HEADER, content, at) if fits else (0, 0, 0, 0, 0, 0)
        if size < FRAME_HEADER_BYTES + CHECKSUM_BYTES or at + size > len(content):
            yield at, len(content), len(content) - at, ts, kind, content[at:], 0, False, False
            return
        body = content[at : at + size - CHECKSUM_BYTES]
        (crc,) = struct.unpack_from(CHECKSUM, content, at + size - CHECKSUM_BYTES)
        yield at, at + size, size, ts, kind, body, crc, zlib.crc32(body) == crc, True
        at += size


def read_segment_files(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all segment files below ``path``. Files are split up in parallel; one file is bounded by
    the rotation limit plus one transaction."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(name.alias("name"), "content").where(F.col("name").rlike(SEGMENT_NAME_PATTERN))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = list(split_frames(bytes(row.content)))
                columns = ["begin", "log_pos", "size", "event_ts", "type", "frame", "crc", "crc_ok", "complete"]
                out = pd.DataFrame(found, columns=columns)
                out.insert(0, "idx", range(len(out)))
                out.insert(0, "segment_id", row.segment_id)
                out.insert(0, "segment_file", row.name)
                yield out

    return named.withColumn("segment_id", segment_number(F.col("name"))).mapInPandas(frames, FRAME_SCHEMA)


def verify_segment_files(frames: DataFrame) -> DataFrame:
    """Per file the end of its longest intact prefix and why it ends: eof or checksum."""
    bad = F.when(F.col("complete") & ~F.col("crc_ok"), F.col("begin"))
    torn = F.when(~F.col("complete"), F.col("begin"))
    return frames.groupBy("segment_file", "segment_id").agg(
        F.coalesce(F.least(F.min(bad), F.min(torn)), F.max("log_pos")).alias("valid_end"),
        F.when(F.min(bad).isNotNull(), "checksum").otherwise("eof").alias("stop_reason"),
    )
