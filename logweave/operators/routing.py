"""Topic partitions and topic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.hashing import key_partition


def route_messages(df: DataFrame, key: str, partitions: int, standard_tail: bool = False) -> DataFrame:
    """Add the topic partition of every message."""
    return df.withColumn("partition", key_partition(F.col(key), partitions, standard_tail))


def partition_balance(df: DataFrame, value: str = "value") -> DataFrame:
    """Messages and bytes per partition and the partition's share of all bytes."""
    per_partition = df.groupBy("partition").agg(
        F.count("*").alias("messages"), F.sum(F.octet_length(value)).alias("bytes")
    )
    total = per_partition.agg(F.sum("bytes")).scalar()
    return per_partition.withColumn("share", F.col("bytes") / total)


def stable_key(*parts: Column) -> Column:
    """Key for messages that have none: derived from where the message comes from, so a replay gives the
    same key and the same partition."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def topic_rows(
    df: DataFrame, topic: Column, value: Column, partitions: int, key: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(topic, key, value, partition) rows for the producer; without ``key`` every row gets a random one."""
    key = F.uuid() if key is None else key
    rows = df.select(*keep, topic.alias("topic"), key.alias("key"), value.alias("value"))
    return route_messages(rows, "key", partitions)


def topic_rows_of_lists(df: DataFrame, topic: Column, keys: Column, values: Column, partitions: int, keep: Sequence[str] = ()) -> DataFrame:
    """The same from a list of keys and a list of values; lists of different length fail the query."""
    paired = F.when(F.size(keys) == F.size(values), F.arrays_zip(keys.alias("key"), values.alias("value"))).otherwise(
        F.raise_error(F.lit("key list and value list differ in length"))
    )
    rows = df.select(*keep, topic.alias("topic"), paired.alias("pairs")).select(
        *keep, "topic", F.posexplode("pairs").alias("idx", "pair")
    )
    rows = rows.select(*keep, "topic", "idx", "pair.key", "pair.value")
    return route_messages(rows, "key", partitions)
