"""Segment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.integers import floor_div

SEGMENTS_PER_FOLDER = 1024


def write_segments(frames: DataFrame, path: str, mode: str = "append", per_folder: int = SEGMENTS_PER_FOLDER) -> None:
    """Placed frames, sorted by (segment_id, log_pos). A folder holds a range of segments: segments are
    small and many, and row-group statistics find one inside its folder."""
    (
        frames.withColumn("segment_range", floor_div(F.col("segment_id"), per_folder))
        .repartitionByRange("segment_range", "segment_id", "log_pos")
        .sortWithinPartitions("segment_range", "segment_id", "log_pos")
        .write.mode(mode)
        .partitionBy("segment_range")
        .parquet(path)
    )


def read_segments(spark: SparkSession, path: str, from_segment: int | None = None, per_folder: int = SEGMENTS_PER_FOLDER) -> DataFrame:
    """Frames of the table; only the folders from ``from_segment`` on are listed and read."""
    frames = spark.read.parquet(path)
    if from_segment is not None:
        frames = frames.where((F.col("segment_range") >= from_segment // per_folder) & (F.col("segment_id") >= from_segment))
    return frames.drop("segment_range")
