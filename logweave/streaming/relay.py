"""Streaming relay: topic in, packs over the hop, topic out; and writers that survive a failing sink."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweave.operators.relay import pack_messages, republish, unpack
from logweave.operators.scan import ROW_SPAN
from logweave.streaming.state import BatchStore

BatchWriter = Callable[[DataFrame, int], None]
log = logging.getLogger(__name__)


def retrying_write(write: BatchWriter, attempts: int, pause_seconds: float) -> BatchWriter:
    """Try again after a pause; after the last attempt the error ends the query, whose restart replays the
    batch. Offsets move on only after success."""

    def batch(df: DataFrame, batch_id: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                return write(df, batch_id)
            except Exception:
                log.exception("batch %s: attempt %s of %s failed", batch_id, attempt, attempts)
                if attempt == attempts:
                    raise
                time.sleep(pause_seconds)

    return batch


def failover_write(primary: BatchWriter, fallbacks: Sequence[BatchWriter]) -> BatchWriter:
    """Write to ``primary``; if that fails to all fallbacks at once. Any success will do, since the reader
    drops copies by id; if all fail, the primary's error stands."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            try:
                primary(df, batch_id)
            except Exception as error:
                log.exception("batch %s: primary sink failed", batch_id)
                if not fallbacks:
                    raise
                with ThreadPoolExecutor(len(fallbacks)) as pool:
                    tries = [pool.submit(write, df, batch_id) for write in fallbacks]
                failed = [t.exception() for t in tries if t.exception() is not None]
                for f in failed:
                    log.error("batch %s: fallback sink failed: %s", batch_id, f)
                if len(failed) == len(tries):
                    raise error
        finally:
            df.unpersist()

    return batch


def table_writer(store: BatchStore, name: str) -> BatchWriter:
    return lambda df, batch_id: store.write(name, batch_id, df)


def log_lines(packs: DataFrame, pack: str = "pack") -> DataFrame:
    """One log line per message of every pack; a missing key or value is empty."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("key", "value")}
    return unpack(packs, pack).select(F.concat(F.lit("key: "), text["key"], F.lit(", value:"), text["value"]).alias("line"))


def log_writer(store: BatchStore, name: str = "log", pack: str = "pack") -> BatchWriter:
    """Every message as a line of text, one folder a batch; a replayed batch replaces its folder."""
    return lambda df, batch_id: log_lines(df, pack).write.mode("overwrite").text(store.path(name, batch_id))


def kafka_writer(options: dict[str, str]) -> BatchWriter:
    """Topic rows to Kafka; needs Spark's Kafka connector on the class path."""
    columns = ["topic", "key", "value", "partition"]
    return lambda df, batch_id: df.select(*columns).write.format("kafka").options(**options).save()


def pack_stream(
    messages: DataFrame,
    write: BatchWriter,
    checkpoint: str,
    max_count: int,
    max_size: int,
    tick_seconds: int,
    topic: str | None = None,
    span: int = ROW_SPAN,
) -> DataStreamWriter:
    """Sending side: each micro-batch is packed and handed to ``write``; its end flushes, like a tick."""
    return messages.writeStream.foreachBatch(
        lambda df, batch_id: write(pack_messages(df, max_count, max_size, tick_seconds, topic, span), batch_id)
    ).option("checkpointLocation", checkpoint)


def republish_stream(packs: DataFrame, write: BatchWriter, checkpoint: str, partitions: int, pack: str = "pack") -> DataStreamWriter:
    """Receiving side: each micro-batch of packs is unpacked to topic rows and handed to ``write``."""
    return packs.writeStream.foreachBatch(
        lambda df, batch_id: write(republish(df, partitions, pack), batch_id)
    ).option("checkpointLocation", checkpoint)


SOURCES = ("table", "files", "kafka")
SINKS = ("table", "kafka", "log")


def open_source(spark, kind: str, options: dict[str, str], schema=None) -> DataFrame:
    """A stream of topic messages: a parquet folder ("table" or "files") or a Kafka topic."""
    if kind not in SOURCES:
        raise ValueError(f"source {kind!r} is not one of {SOURCES}")
    if kind == "kafka":
        stream = spark.readStream.format("kafka").options(**options).load()
        return stream.select(
            F.col("key").cast("string"), "value", "topic", "partition", "offset", F.col("timestamp").alias("ts")
        )
    path = options["path"]
    rest = {k: v for k, v in options.items() if k != "path"}
    return spark.readStream.schema(schema).options(**rest).parquet(path)


def open_sink(kind: str, options: dict[str, str]) -> BatchWriter:
    if kind not in SINKS:
        raise ValueError(f"sink {kind!r} is not one of {SINKS}")
    if kind == "kafka":
        return kafka_writer(options)
    store = BatchStore(options["path"])
    return log_writer(store, options.get("name", "log")) if kind == "log" else table_writer(store, options.get("name", "packs"))
