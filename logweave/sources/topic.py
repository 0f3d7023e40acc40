"""Reading topics: Kafka options and the table form."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.relay import decode_messages, message_scope
from logweave.operators.small import join_small


def starting_offsets(topic: str, saved: Mapping[int, int], partitions: int) -> str:
    """Kafka's ``startingOffsets``: the saved offset itself (it is read again), oldest (-2) where none is."""
    return json.dumps({topic: {str(p): int(saved.get(p, -2)) for p in range(partitions)}})


def kafka_source_options(
    servers: str, topic: str, saved: Mapping[int, int], partitions: int, max_offsets_per_trigger: int | None = None
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets(topic, saved, partitions),
        "failOnDataLoss": "true",
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_stream(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load()


def read_from_offsets(topic: DataFrame, offsets: DataFrame) -> DataFrame:
    """Messages from each partition's saved offset on (inclusive), or from its start, decoded. Offsets saved with
    their topic hold for that topic only."""
    keys = [c for c in message_scope(topic) if c in offsets.columns]
    saved = offsets.select(*keys, F.col("offset").alias("saved"))
    wanted = join_small(topic, saved, keys).where(F.col("offset") >= F.coalesce("saved", F.lit(0)))
    return decode_messages(wanted.drop("saved"))


def partition_stream(topic: DataFrame) -> DataFrame:
    """Messages in offset order within their partition. Cut by ranges, so that a partition holding much
    of the topic spreads over consecutive tasks instead of filling one."""
    return topic.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset")
