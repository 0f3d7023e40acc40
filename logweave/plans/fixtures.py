"""Change logs, topics and segment frames derived from the driver tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.cyclic import seqid_at
from logweave.functions.envelope import encode_envelope
from logweave.functions.integers import floor_div
from logweave.operators.scan import block_of, dense_rank_rows, spread
from logweave.operators.segments import rewrite_positions

RULES = ["DB0@t[012]", "db1@t[012]"]
MAX_SIZE = 120
FILE_EVENTS = 1000
SPAN = 1 << 16  # positions of these logs are row numbers, not bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log_of(events: DataFrame) -> DataFrame:
    """The event table read as a replication log of eight sources."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    kind = (
        F.when(F.col("event_type").isin("signup", "error"), "QUERY")
        .when(F.col("event_type") == "view", "TABLE_MAP")
        .when(F.col("event_type") == "click", "ROWS")
        .when(F.col("event_type") == "purchase", "XID")
        .otherwise("OTHER")
    )
    query = F.when(
        F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 1, "BeGin").otherwise("begin")
    ).when(F.col("event_type") == "error", "ALTER")
    file_no = floor_div(F.col("event_id"), FILE_EVENTS).cast("string")
    return events.select(
        (F.col("user_id") % 8).alias("source_id"),
        F.concat(F.lit("binlog-"), F.lpad(file_no, 10, "0"), F.lit(".log")).alias("log_file"),
        F.col("event_id").alias("log_pos"),
        F.col("ts").alias("event_ts"),
        kind.alias("kind"),
        query.alias("query"),
        F.concat(F.lit("DB"), (k % 3).cast("string")).alias("schema_name"),
        F.concat(F.lit("T"), (k % 5).cast("string")).alias("table_name"),
        (20 + F.length("props") + F.floor("value").cast("bigint") % 50).cast("bigint").alias("size"),
        F.col("props").cast("binary").alias("raw"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log_of(table(spark, sf_dir, "events"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order: BEGIN, TABLE_MAP, one ROWS event per line number, XID.

    Lines sharing a line number travel in one ROWS event, so positions stay unique.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem")
    lines = (
        spread(items, ["l_orderkey"], items.count())
        .groupBy("l_orderkey", "l_linenumber")
        .agg((F.count("*") * 60 + F.sum(F.col("l_quantity").cast("bigint"))).alias("size"))
    )
    head = orders.select(
        "*", F.explode(F.expr("array(named_struct('step', 0, 'kind', 'QUERY', 'size', 60L), named_struct('step', 1, 'kind', 'TABLE_MAP', 'size', 50L), named_struct('step', 15, 'kind', 'XID', 'size', 31L))")).alias("e")
    ).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "e.step", "e.kind", "e.size")
    body = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
        (F.col("l_linenumber") + 1).alias("step"), F.lit("ROWS").alias("kind"), "size",
    )
    return head.unionByName(body).select(
        (F.col("o_custkey") % 16).alias("source_id"),
        F.concat(F.lit("binlog-"), F.year("o_orderdate").cast("string"), F.lit(".log")).alias("log_file"),
        (F.col("o_orderkey") * 16 + F.col("step")).alias("log_pos"),
        F.col("o_orderdate").alias("event_ts"),
        "kind",
        F.when(F.col("step") == 0, "BEGIN").alias("query"),
        F.lit("shop").alias("schema_name"),
        F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("table_name"),
        F.col("size").cast("bigint").alias("size"),
    )


ORDER_RULES = ["shop@orders_[fo]"]
ORDER_SPAN = 1 << 24


PARTITIONS = 3
ARRIVAL_SPAN = 1 << 22
WRAP_START = 10**12 - 4999  # the cycle ends within the first 5,000 ids
STALE_START = 501


def _arrival(event_id):
    # a bijective shuffle of the ids
    return (event_id * 48271) % 2147483647


def topic_messages(spark: SparkSession, sf_dir: str, variant: str = "dense", start: int = 1) -> DataFrame:
    """The event table as an out-of-order topic of three partitions.

    dense: every id once. dups: some messages arrive twice. gap: some ids never arrive.
    late_gap: few ids never arrive, and some messages twice. whole: every id, and some messages twice.
    Except in these two, every 211th value is junk.
    ``start`` is the first id.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    if variant == "gap":
        events = events.where(F.col("event_id") % 997 != 13)
    if variant == "late_gap":
        events = events.where(F.col("event_id") % 6007 != 6006)
    messages = events.withColumn("arrival", _arrival(F.col("event_id")))
    if variant in ("dups", "late_gap", "whole"):
        again = events.where(F.col("event_id") % 101 == 7).withColumn("arrival", _arrival(F.col("event_id")) + 2147483647)
        messages = messages.unionByName(again)
    seqid = seqid_at(start, F.col("event_id"))
    envelope = encode_envelope(seqid, F.array(F.col("props").cast("binary")))
    value = envelope if variant in ("late_gap", "whole") else F.when(F.col("event_id") % 211 == 210, "junk").otherwise(envelope)
    keyed = messages.select(
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"),
        value.cast("binary").alias("value"),
        F.lit("changes").alias("topic"),
        (F.col("event_id") % PARTITIONS).cast("int").alias("partition"),
        "arrival",
        "ts",
        floor_div(F.col("arrival"), ARRIVAL_SPAN).alias("block"),
    )
    ranked = dense_rank_rows(keyed, ["partition"], [["block"]], ["arrival"], "rn")
    return ranked.withColumn("offset", F.col("rn") - 1).drop("rn", "block")


def ordered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a topic in id order, as a collector writes it."""
    return messages_of(table(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"),
        F.col("props").cast("binary").alias("value"),
        F.lit("changes").alias("topic"),
        (F.col("event_id") % PARTITIONS).cast("int").alias("partition"),
        floor_div(F.col("event_id"), PARTITIONS).alias("offset"),
        "ts",
    )


SEGMENT_EVENTS = 1000


def frames_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unplaced frames: thousand events per segment."""
    log = change_log(spark, sf_dir)
    return log.select(
        floor_div(F.col("log_pos"), SEGMENT_EVENTS).alias("segment_id"),
        (F.col("log_pos") + 1).alias("seqid"),
        "event_ts",
        "size",
        F.col("raw").alias("frame"),
    )


def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed frames, some with a damaged checksum."""
    placed = rewrite_positions(frames_of_events(spark, sf_dir), ["seqid"], block_of(F.col("seqid"), SPAN))
    damaged = (F.col("seqid") - 1) % 503 == 499
    return placed.withColumn("crc", F.when(damaged, F.col("crc") + 1).otherwise(F.col("crc")))
