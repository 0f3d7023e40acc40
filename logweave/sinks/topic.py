"""Writing topic rows to Kafka or to a topic table."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Wait for every replica, compress with gzip.
KAFKA_ACKS = "all"
KAFKA_COMPRESSION = "gzip"


def kafka_sink_options(servers: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": KAFKA_ACKS,
        "kafka.compression.type": KAFKA_COMPRESSION,
    }


def write_topic(rows: DataFrame, servers: str) -> None:
    """Write (topic, key, value, partition) rows; needs Spark's Kafka connector on the class path."""
    rows.select("topic", "key", "value", "partition").write.format("kafka").options(**kafka_sink_options(servers)).save()


def write_topic_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    """The same into a table partitioned like the topic."""
    (
        rows.repartitionByRange("topic", "partition", *[c for c in ("seqid", "idx") if c in rows.columns], "key")
        .write.mode(mode)
        .option("compression", KAFKA_COMPRESSION)
        .partitionBy("topic", "partition")
        .parquet(path)
    )
