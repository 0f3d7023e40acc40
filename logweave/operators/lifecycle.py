"""Ageing of log tables and the latest state per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.integers import floor_div

# Days after which a log is compressed and after which it is removed.
COMPRESS_AFTER_DAYS = 1
EXPIRE_AFTER_DAYS = 3


def tier_by_age(df: DataFrame, modified: Column, now: Column, compress_after: int = COMPRESS_AFTER_DAYS, expire_after: int = EXPIRE_AFTER_DAYS) -> DataFrame:
    """Add ``tier``: hot, compressed or expired, by whole 24-hour units of age. Times are epoch seconds."""
    age_days = floor_div(now - modified, 86400)
    return df.withColumn(
        "tier",
        F.when(age_days > expire_after, "expired").when(age_days > compress_after, "compressed").otherwise("hot"),
    )


def write_tiers(tiered: DataFrame, path: str, partition: str) -> None:
    """Rewrite a day-partitioned table under its tiers: hot days fast to write, older ones gzipped, expired
    ones left out."""
    for tier, codec in (("hot", "snappy"), ("compressed", "gzip")):
        (
            tiered.where(F.col("tier") == tier)
            .drop("tier")
            .write.mode("overwrite")
            .option("compression", codec)
            .partitionBy(partition)
            .parquet(f"{path}/tier={tier}")
        )


DELETED = "__deleted"


def latest_rows(records: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key.

    A grouped maximum instead of a window: a key with very many versions is folded before the shuffle.
    """
    values = [c for c in records.columns if c not in {*key, *order}]
    latest = records.groupBy(*key).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("row"))
    return latest.select(*key, *[f"row.{c}" for c in (*order, *values)])


def apply_latest(records: DataFrame, key: Sequence[str], order: Sequence[str], deleted: Column) -> DataFrame:
    """Latest row per key in log order, keys whose latest row deletes them left out."""
    marked = records.withColumn(DELETED, F.coalesce(deleted, F.lit(False)))
    return latest_rows(marked, key, order).where(~F.col(DELETED)).drop(DELETED)
