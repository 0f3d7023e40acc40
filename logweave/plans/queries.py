"""The registered queries: every operator over the whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.envelope import encode_envelope, total_bytes
from logweave.functions.integers import floor_div
from logweave.functions.times import epoch_seconds
from logweave.operators import bookkeeping, lifecycle, metrics, relay, routing, rules, segments, sequence, transactions
from logweave.operators.small import join_small
from logweave.plans import collector
from logweave.plans import fixtures as fx
from logweave.session import checkpoint_root, cut_lineage
from logweave.sinks.segments import read_segments, write_segments
from logweave.sinks.tiers import AgedTable
from logweave.sources import changelog, topic
from logweave.streaming.collector import collect_stream
from logweave.streaming.commits import CommitLog, commit_writer
from logweave.streaming.figures import LiveFigures
from logweave.streaming.latest import LatestTable, upsert_stream
from logweave.streaming.ledger import IdLedger
from logweave.streaming.relay import (
    failover_write,
    log_lines,
    open_sink,
    pack_stream,
    retrying_write,
    table_writer,
)
from logweave.streaming.replayer import resequence_stream
from logweave.streaming.state import BatchStore
from logweave.streaming.tail import position, tail_segments
from logweave.streaming.watermark import watermark_stream

RULES = rules.parse_rules(fx.RULES)
ORDER_RULES = rules.parse_rules(fx.ORDER_RULES)
REPLAY_SEGMENT, REPLAY_POS = 2, 5000
TAIL_SEGMENT, TAIL_POS = 1, 1500
ORDER_MAX_SIZE = 400
SEQ_START = 10**12 - 999  # the counter wraps after a thousand records
SEGMENT_LIMIT = 4000
PACK_COUNT, PACK_SIZE, PACK_TICK = 10, 80, 86400
WINDOW = 50
ROW_GROUP = 4 << 20  # bytes; a file is a micro-batch, and tasks share it by row groups
FIGURES_NOW = 1706659200  # 2024-01-31

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(column: str):
    return F.col(column).cast("string").alias(column)


# ---- rules and predicates ------------------------------------------------------------------------


@query
def parse_rules(spark, sf):
    """Rule settings kept as rows, grouped by database."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    rows = fx.table(spark, sf, "events").select(
        F.concat(F.lit("DB"), (k % 7).cast("string"), F.lit("@t["), (k % 5).cast("string"), F.lit("]")).alias("rule")
    )
    return rules.parse_rule_rows(rows.distinct()).select(
        "schema_name", F.concat_ws(",", "table_regexes").alias("table_regexes")
    )


@query
def filter_schema(spark, sf):
    return rules.filter_schema(fx.change_log(spark, sf), RULES).select("source_id", "log_pos", "schema_name", "size")


@query
def filter_tables(spark, sf):
    return rules.filter_tables(fx.change_log(spark, sf), RULES).select(
        "source_id", "log_pos", "schema_name", "table_name"
    )


def _rule_rows(spark, sf):
    """Rules kept as a table, drawn from the events: some databases of the log, others that it never names."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    rows = fx.table(spark, sf, "events").where(k % 7 != 1).select(
        F.concat(F.lit("Db"), (k % 7).cast("string"), F.lit("@t["), (k % 4).cast("string"), F.lit("]")).alias("rule")
    )
    return rules.parse_rule_rows(rows.distinct())


@query
def filter_schema_by_rule_rows(spark, sf):
    wanted = rules.filter_schema(fx.change_log(spark, sf), _rule_rows(spark, sf))
    return wanted.select("source_id", "log_pos", "schema_name", "size")


@query
def filter_tables_by_rule_rows(spark, sf):
    wanted = rules.filter_tables(fx.change_log(spark, sf), _rule_rows(spark, sf))
    return wanted.select("source_id", "log_pos", "schema_name", "table_name")


@query
def route_kinds_by_rule_rows(spark, sf):
    routed = rules.route_events(fx.change_log(spark, sf), _rule_rows(spark, sf), span=fx.SPAN)
    return routed.select("source_id", "log_pos", "kind", "action")


@query
def is_begin(spark, sf):
    log = fx.change_log(spark, sf)
    return log.select("log_pos", rules.is_begin(F.col("query")).alias("begins"))


@query
def carry_table_decision(spark, sf):
    routed = rules.route_events(fx.change_log(spark, sf), RULES, span=fx.SPAN)
    return routed.select("source_id", "log_pos", "kind", "epoch", "keep", "in_tx")


@query
def route_kinds(spark, sf):
    routed = rules.route_events(fx.change_log(spark, sf), RULES, span=fx.SPAN)
    return routed.select("source_id", "log_pos", "kind", "action")


@query
def override_topic(spark, sf):
    named = fx.table(spark, sf, "events").select("event_id", F.col("event_type").alias("topic"))
    return named.select(
        "event_id",
        relay.override_topic("", F.col("topic")).alias("kept"),
        relay.override_topic("archive", F.col("topic")).alias("replaced"),
    )


@query
def drop_bad_envelopes(spark, sf):
    good, dead = relay.split_bad_envelopes(fx.topic_messages(spark, sf, "dups"))
    columns = ["partition", "offset", "key"]
    return good.select(*columns, "seqid", F.size("data").alias("events"), F.lit("good").alias("output")).unionByName(
        dead.select(*columns, F.lit(0).cast("bigint").alias("seqid"), F.lit(0).alias("events"), F.lit("dead").alias("output"))
    )


@query
def segments_matching(spark, sf):
    """File names, some of them not segments."""
    names = fx.change_log(spark, sf).select(
        F.when(F.col("kind") == "OTHER", F.concat("log_file", F.lit(".tmp")))
        .when(F.col("kind") == "XID", F.concat(F.lit("old-"), "log_file"))
        .otherwise(F.col("log_file"))
        .alias("name")
    )
    return segments.segments_matching(names).groupBy("name", "segment_number").agg(F.count("*").alias("n"))


@query
def newest_and_oldest_segment(spark, sf):
    return segments.newest_and_oldest(fx.change_log(spark, sf).withColumnRenamed("log_file", "name"))


# ---- transactions and records --------------------------------------------------------------------


@query
def newest_and_oldest_unpadded(spark, sf):
    """Numbers of different width: newest and oldest go by number, not by text."""
    names = fx.table(spark, sf, "events").select(segments.segment_name(F.col("event_id") % 7 + 7).alias("name"))
    return segments.newest_and_oldest(names)


@query
def assemble_transactions(spark, sf):
    return transactions.assemble_transactions(fx.change_log(spark, sf), RULES, span=fx.SPAN)


@query
def drop_empty_transactions(spark, sf):
    """Transactions by emptiness: how many commits there are, and how many of them send something."""
    log = fx.change_log(spark, sf)
    commits = log.where(F.col("kind") == "XID").groupBy("source_id").agg(F.count("*").alias("commits"))
    sent = transactions.assemble_transactions(log, RULES, span=fx.SPAN).groupBy("source_id").agg(
        F.count("*").alias("sent"), F.min("n_events").alias("smallest")
    )
    return commits.join(sent, "source_id", "left")


@query
def split_transactions(spark, sf):
    parts = transactions.split_transactions(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, span=fx.SPAN)
    return parts.select("source_id", "epoch", "log_pos", "part", "is_cut")


@query
def standalone_records(spark, sf):
    alone = transactions.standalone_events(fx.change_log(spark, sf), RULES, span=fx.SPAN)
    return alone.select("source_id", "log_pos", "kind", "size")


@query
def record_headers(spark, sf):
    headers = transactions.record_headers(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, span=fx.SPAN)
    return headers.select(
        "source_id", "epoch", "part", "n_events", "bytes", "first_pos", "log_file", "log_pos", "committed"
    )


@query
def build_records(spark, sf):
    """Whole records with their payload in order."""
    built = transactions.build_records(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, span=fx.SPAN)
    return built.select(
        "source_id",
        "log_pos",
        "n_events",
        total_bytes(F.col("data")).alias("payload_bytes"),
        F.concat_ws("|", F.transform("data", lambda b: b.cast("string"))).alias("payload"),
    )


@query
def order_log_transactions(spark, sf):
    return transactions.assemble_transactions(fx.order_log(spark, sf), ORDER_RULES, span=fx.ORDER_SPAN)


@query
def order_log_records(spark, sf):
    headers = transactions.record_headers(fx.order_log(spark, sf), ORDER_RULES, ORDER_MAX_SIZE, span=fx.ORDER_SPAN)
    return headers.select("source_id", "part", "n_events", "bytes", "first_pos", "log_pos", "committed")


@query
def last_position(spark, sf):
    headers = transactions.record_headers(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, span=fx.SPAN)
    return bookkeeping.last_position(headers)


# ---- sources -------------------------------------------------------------------------------------


@query
def read_changelog(spark, sf):
    """Restart from positions saved on the 15th; two sources have none."""
    log = fx.change_log(spark, sf)
    saved = bookkeeping.last_position(
        log.where((F.col("event_ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00'")) & (F.col("source_id") < 6))
    )
    return changelog.read_changelog(log, saved).select("source_id", "log_file", "log_pos", "kind")


@query
def read_from_offsets(spark, sf):
    """Restart of two partitions from their middle; the third starts at its beginning."""
    messages = fx.topic_messages(spark, sf, "dups")
    saved = messages.where(F.col("partition") < 2).groupBy("partition").agg(
        floor_div(F.max("offset"), 2).alias("offset")
    )
    read = topic.read_from_offsets(messages, saved)
    return read.select("partition", "offset", "key", F.coalesce("seqid", F.lit(0)).alias("seqid"))


@query
def partition_stream(spark, sf):
    stream = topic.partition_stream(fx.topic_messages(spark, sf, "dups"))
    return stream.select("partition", "offset", "key")


@query
def order_within_source(spark, sf):
    return sequence.order_within_source(fx.change_log(spark, sf)).select("source_id", "log_file", "log_pos", "kind")


# ---- sequencing ----------------------------------------------------------------------------------


@query
def assign_seqid(spark, sf):
    numbered = collector.numbered_headers(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, SEQ_START, span=fx.SPAN)
    return numbered.select("source_id", "log_file", "log_pos", "n_events", "seqid")


@query
def fan_in(spark, sf):
    """The event log and the order log under one counter."""
    log = fx.change_log(spark, sf).select("source_id", "log_file", "log_pos", "event_ts", "size")
    orders = fx.order_log(spark, sf).select(
        (F.col("source_id") + 8).alias("source_id"), "log_file", "log_pos", "event_ts", "size"
    )
    return sequence.fan_in([log, orders], span=fx.ORDER_SPAN).select("source_id", "log_file", "log_pos", "seqid")


@query
def publish_records(spark, sf):
    """Records as envelopes on their topic partitions."""
    records = collector.numbered_records(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, SEQ_START, span=fx.SPAN)
    return collector.record_topic_rows(records, "changes", fx.PARTITIONS)


def _good(spark, sf, variant, start=1):
    good, _ = relay.split_bad_envelopes(fx.topic_messages(spark, sf, variant, start))
    return good


@query
def resequence(spark, sf):
    """From a start id inside the stream, with copies, stale ids and a gap."""
    released = sequence.resequence(_good(spark, sf, "late_gap"), fx.STALE_START)
    return released.select("seqid", "d", "partition", "offset", "key")


@query
def resequence_wrapped(spark, sf):
    """Across the end of the id cycle."""
    released = sequence.resequence(_good(spark, sf, "late_gap", fx.WRAP_START), fx.WRAP_START)
    return released.select("seqid", "d", "partition", "offset", "key")


@query
def resequence_whole(spark, sf):
    """Every id arrives, so every id is released."""
    released = sequence.resequence(_good(spark, sf, "whole"), 1)
    return released.select("seqid", "d", "partition", "offset", "key")


@query
def resequence_whole_wrapped(spark, sf):
    """As ``resequence_whole``, over the end of the id cycle."""
    released = sequence.resequence(_good(spark, sf, "whole", fx.WRAP_START), fx.WRAP_START)
    return released.select("seqid", "d", "partition", "offset", "key")


def _delivered_again(messages):
    """Every 101st and every 7th message once more, under the same partition and offset."""
    again = [messages.where(F.col("arrival") % n == 3) for n in (101, 7)]
    return messages.unionByName(again[0]).unionByName(again[1])


@query
def resequence_delivered_again(spark, sf):
    """Messages that a reader gets twice or three times go out once."""
    released = sequence.resequence(_delivered_again(_good(spark, sf, "whole")), 1)
    return released.select("seqid", "d", "partition", "offset", "key")


@query
def pending_status_delivered_again(spark, sf):
    """How many deliveries of each message have which status."""
    decoded = _delivered_again(relay.decode_messages(fx.topic_messages(spark, sf, "dups")))
    marked = sequence.message_status(decoded, fx.STALE_START, WINDOW)
    return marked.groupBy("partition", "offset", "status").agg(F.count("*").alias("deliveries"))


@query
def drop_stale(spark, sf):
    kept = sequence.drop_stale(_good(spark, sf, "dups"), fx.STALE_START)
    return kept.select("seqid", "partition", "offset", "key")


@query
def pending_status(spark, sf):
    decoded = relay.decode_messages(fx.topic_messages(spark, sf, "dups"))
    marked = sequence.message_status(decoded, fx.STALE_START, WINDOW)
    return marked.select("partition", "offset", F.coalesce("seqid", F.lit(0)).alias("seqid"), "status")


@query
def gap_report(spark, sf):
    return sequence.gap_report(_good(spark, sf, "gap"), 1)


@query
def last_offsets(spark, sf):
    processed = _good(spark, sf, "dups").withColumn("ord", F.col("arrival"))
    return bookkeeping.last_offsets(processed).select("partition", "offset", "seqid")


def _two_topics(spark, sf):
    """Two topics whose partitions and offsets have the same numbers."""
    other = fx.topic_messages(spark, sf, "gap").withColumn("topic", F.lit("audit"))
    return fx.topic_messages(spark, sf, "dups").unionByName(other)


@query
def last_offsets_two_topics(spark, sf):
    good, _ = relay.split_bad_envelopes(_two_topics(spark, sf))
    return bookkeeping.last_offsets(good.withColumn("ord", F.col("arrival"))).select("topic", "partition", "offset", "seqid")


@query
def contiguous_watermark_two_topics(spark, sf):
    good, _ = relay.split_bad_envelopes(_two_topics(spark, sf))
    return bookkeeping.contiguous_watermark(good, 0).select("topic", "partition", "watermark")


@query
def read_from_offsets_two_topics(spark, sf):
    """Two partitions of one topic go on from their middle, everything else from its start."""
    messages = _two_topics(spark, sf)
    saved = messages.where((F.col("partition") < 2) & (F.col("topic") == "changes")).groupBy("topic", "partition").agg(
        floor_div(F.max("offset"), 2).alias("offset")
    )
    read = topic.read_from_offsets(messages, saved)
    return read.select("topic", "partition", "offset", "key", F.coalesce("seqid", F.lit(0)).alias("seqid"))


@query
def resequence_two_topics(spark, sf):
    """Ids that arrive over two topics under the same partitions and offsets."""
    good, _ = relay.split_bad_envelopes(_two_topics(spark, sf))
    released = sequence.resequence(good, 1)
    return released.select("seqid", "d", "topic", "partition", "offset", "key")


@query
def offset_book(spark, sf):
    processed = _good(spark, sf, "dups").withColumn("ord", F.col("arrival"))
    book = bookkeeping.offset_book(processed)
    pairs = F.array_sort(F.transform(F.map_entries("offsets"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))))
    return book.select(F.concat_ws(",", pairs).alias("offsets"), "seqid")


@query
def contiguous_watermark(spark, sf):
    """Offsets whose message was processed; those with a junk value were not."""
    done = _good(spark, sf, "gap")
    return bookkeeping.contiguous_watermark(done, 0).select("partition", "watermark")


# ---- relay ---------------------------------------------------------------------------------------


@query
def route_messages(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("key"),
    )
    return routing.route_messages(rows, "key", 6)


@query
def partition_balance(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("value")
    )
    return routing.partition_balance(routing.route_messages(rows, "key", 6))


@query
def write_topic_rows(spark, sf):
    """Rows for the producer under keys that a replay reproduces."""
    log = fx.change_log(spark, sf)
    key = routing.stable_key(F.col("source_id"), F.col("log_file"), F.col("log_pos"))
    rows = routing.topic_rows(log, F.lit("changes"), F.col("raw").cast("string"), 6, key, keep=["log_pos"])
    return rows.select("log_pos", "topic", "key", "value", "partition")


@query
def write_topic_key_lists(spark, sf):
    """A list of keys and a list of values per user and day."""
    events = fx.table(spark, sf, "events")
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "props")))
    lists = events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(pairs.alias("pairs"))
    rows = routing.topic_rows_of_lists(
        lists,
        F.lit("changes"),
        F.transform("pairs", lambda p: F.concat_ws("-", p["event_type"], p["event_id"].cast("string"))),
        F.transform("pairs", lambda p: p["props"]),
        6,
        keep=["user_id"],
    )
    return rows.select("user_id", "idx", "topic", "key", "value", "partition")


@query
def pack_messages(spark, sf):
    packs = relay.pack_messages(fx.ordered_messages(spark, sf), PACK_COUNT, PACK_SIZE, PACK_TICK, span=fx.SPAN)
    return packs.select("topic", "partition", "tick", "part", "messages", "bytes", "first_offset", "last_offset", "pack")


@query
def pack_messages_two_topics(spark, sf):
    """Two topics with the same partitions and offsets: their packs stay apart."""
    both = fx.ordered_messages(spark, sf).withColumn("topic", F.explode(F.array(F.lit("left"), F.lit("right"))))
    packs = relay.pack_messages(both, PACK_COUNT, PACK_SIZE, PACK_TICK, span=256)  # ten blocks and more
    return packs.select("topic", "partition", "tick", "part", "messages", "bytes", "first_offset", "last_offset", "pack")


def _packs(spark, sf):
    return relay.pack_messages(
        fx.ordered_messages(spark, sf), PACK_COUNT, PACK_SIZE, PACK_TICK, topic="archive", span=fx.SPAN
    )


@query
def unpack(spark, sf):
    return relay.unpack(_packs(spark, sf)).select("topic", "idx", "key", _text("value"))


@query
def log_rows(spark, sf):
    """What the log sink prints."""
    return log_lines(_packs(spark, sf))


@query
def republish(spark, sf):
    return relay.republish(_packs(spark, sf), 6).select("topic", "key", _text("value"), "partition")


# ---- segments ------------------------------------------------------------------------------------


@query
def segment_log(spark, sf):
    numbered = collector.numbered_headers(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, span=fx.SPAN)
    records = cut_lineage(numbered.select("seqid", "bytes", "committed"))
    return segments.segment_log(records, SEGMENT_LIMIT)


@query
def segment_log_wrapped(spark, sf):
    """The same cuts with ids that pass the end of their cycle."""
    numbered = collector.numbered_headers(fx.change_log(spark, sf), RULES, fx.MAX_SIZE, start=SEQ_START, span=fx.SPAN)
    records = cut_lineage(numbered.select("seqid", "bytes", "committed"))
    return segments.segment_log(records, SEGMENT_LIMIT, start=SEQ_START, span=64)


@query
def rewrite_positions(spark, sf):
    placed = segments.rewrite_positions(
        fx.frames_of_events(spark, sf), ["seqid"], fx.block_of(F.col("seqid"), fx.SPAN)
    )
    return placed.select("segment_id", "seqid", "size", "log_pos", "crc")


@query
def verify_segments(spark, sf):
    return segments.verify_segments(fx.segment_frames(spark, sf))


@query
def check_on_read(spark, sf):
    """Intact frames pass, damaged ones are set aside."""
    intact, damaged = segments.quarantine(fx.segment_frames(spark, sf))
    columns = ["segment_id", "seqid", "log_pos"]
    return (
        segments.check_on_read(intact).select(*columns, F.lit("intact").alias("state"), F.length("frame").alias("frame_bytes"))
        .unionByName(damaged.select(*columns, F.lit("damaged").alias("state"), F.length("frame").alias("frame_bytes")))
    )


@query
def segment_manifest(spark, sf):
    manifest = segments.segment_manifest(fx.segment_frames(spark, sf))
    return manifest.withColumns(
        {
            "first_ts": epoch_seconds(F.col("first_ts")),
            "last_ts": epoch_seconds(F.col("last_ts")),
            "next_segment": F.coalesce("next_segment", F.lit(-1)),
        }
    )


@query
def write_segments_table(spark, sf):
    """Frames written as a segment table and read back."""
    return _segment_table(spark, sf).select("segment_id", "seqid", "size", "log_pos", "crc")


@query
def read_segments_pruned(spark, sf):
    """The same from segment 1 on; folders before it are not listed."""
    return _segment_table(spark, sf, from_segment=1).select("segment_id", "seqid", "size", "log_pos", "crc")


def _segment_table(spark, sf, from_segment=None):
    path = f"{checkpoint_root(spark)}/segment-table-{uuid.uuid4().hex}"
    write_segments(fx.segment_frames(spark, sf), path, per_folder=4)
    return read_segments(spark, path, from_segment, per_folder=4)


@query
def scan_segments(spark, sf):
    return segments.scan_segments(fx.segment_frames(spark, sf), REPLAY_SEGMENT, REPLAY_POS).select(
        "segment_id", "log_pos", "seqid"
    )


@query
def replay_from(spark, sf):
    """A consumer's frames from a position on, checked on the way."""
    intact, _ = segments.quarantine(fx.segment_frames(spark, sf))
    frames = segments.replay_from(intact, REPLAY_SEGMENT, REPLAY_POS)
    return frames.select("segment_id", "log_pos", F.col("frame").cast("string").alias("frame"))


# ---- metrics and lifecycle -----------------------------------------------------------------------


@query
def throughput(spark, sf):
    """Per source and per hour; at this rate of events per second only busy hours are above 0."""
    return metrics.throughput(fx.change_log(spark, sf), "event_ts", 3600, ["source_id"])


@query
def throughput_orders(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"))
    return metrics.throughput(lines, "ts", 60 * 60 * 24)


@query
def freshness(spark, sf):
    now = F.lit(1706659200)  # 2024-01-31
    return metrics.freshness(fx.change_log(spark, sf), now)


@query
def concurrency_gauge(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "event_type")
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return metrics.concurrency_gauge(events, "event_id", delta, fx.SPAN).select("event_id", "connected")


@query
def tier_by_age(spark, sf):
    log = fx.change_log(spark, sf)
    files = log.groupBy("log_file").agg(F.max(epoch_seconds(F.col("event_ts"))).alias("modified"))
    now = log.agg(F.max(epoch_seconds(F.col("event_ts")))).scalar()
    return lifecycle.tier_by_age(files, F.col("modified"), now)


@query
def age_log_files(spark, sf):
    """Log files aged twice, a day apart: those left after the second time, in their tiers."""
    log = fx.change_log(spark, sf).select("log_file", "log_pos", "source_id", epoch_seconds(F.col("event_ts")).alias("seconds"))
    table = AgedTable(f"{checkpoint_root(spark)}/aged-{uuid.uuid4().hex}", "log_file")
    table.add(log, F.col("seconds"))
    now = log.agg(F.max("seconds")).first()[0]
    for at in (now - 86400, now):
        table.age(spark, at)
    tiers = spark.createDataFrame(list(table.tiers(spark).items()), "log_file string, tier string")
    return join_small(table.read(spark), tiers, ["log_file"]).select("log_file", "tier", "log_pos", "source_id")


@query
def apply_latest(spark, sf):
    """Latest event per user and table; the latest being an XID removes the row."""
    log = fx.change_log(spark, sf)
    rows = log.select("schema_name", "table_name", "source_id", "log_file", "log_pos", "kind", "size")
    return lifecycle.apply_latest(
        rows, ["source_id", "schema_name", "table_name"], ["log_file", "log_pos"], F.col("kind") == "XID"
    )


# ---- streams -------------------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _store(spark, name):
    return BatchStore(f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}")


def _finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


@query
def stream_records(spark, sf):
    """The collector as a stream over the event table."""
    store = _store(spark, "records")
    _finish(collect_stream(fx.change_log_of(_event_stream(spark, sf)), RULES, fx.MAX_SIZE, store, span=fx.SPAN))
    return store.read(spark, "records").select(
        "source_id", "log_file", "log_pos", "n_events", "bytes", "committed", "seqid",
        F.concat_ws("|", F.transform("data", lambda b: b.cast("string"))).alias("payload"),
    )


@query
def stream_records_in_batches(spark, sf):
    """The collector over micro-batches that cut transactions anywhere: keys and records are those of the whole log."""
    store = _store(spark, "records")
    log = fx.change_log_of(_ordered_batches(spark, sf, files=6))
    _finish(collect_stream(log, RULES, fx.MAX_SIZE, store, span=fx.SPAN))
    return store.read(spark, "records").select(
        "source_id", "epoch", "part", "log_file", "log_pos", "n_events", "bytes", "committed",
        F.concat_ws("|", F.transform("data", lambda b: b.cast("string"))).alias("payload"),
    )


@query
def stream_records_two_collectors(spark, sf):
    """Two collectors, each for half of the sources, under one counter: their records, and how many ids that took up to which."""
    ledger, stores = IdLedger(_store(spark, "ledger").root), [_store(spark, "records") for _ in range(2)]
    log = fx.change_log_of(_event_stream(spark, sf))
    writers = [
        collect_stream(log.where(F.col("source_id") % 2 == i), RULES, fx.MAX_SIZE, store, span=fx.SPAN, ledger=ledger, owner=f"collector-{i}")
        for i, store in enumerate(stores)
    ]
    for running in [w.trigger(availableNow=True).start() for w in writers]:  # at once
        running.awaitTermination()
    records = stores[0].read(spark, "records").unionByName(stores[1].read(spark, "records"))
    ids = records.agg(F.count_distinct("seqid").alias("ids"), F.min("seqid").alias("first_id"), F.max("seqid").alias("last_id"))
    return records.crossJoin(F.broadcast(ids)).select(  # a single row
        "source_id", "log_file", "log_pos", "n_events", "bytes", "committed", "ids", "first_id", "last_id"
    )


@query
def stream_figures(spark, sf):
    """What a running collector reports: a report after each batch, and one after an idle interval behind it."""
    reports, store = [], _store(spark, "records")
    figures = LiveFigures(WINDOW, reports.append, clock=lambda: FIGURES_NOW)

    def reporting(records, batch_id):
        figures.report()
        figures.report()

    log = fx.change_log_of(_ordered_batches(spark, sf, files=3))
    _finish(collect_stream(log, RULES, fx.MAX_SIZE, store, span=fx.SPAN, sink=reporting, figures=figures))
    names = ["report", "events", "total", "avg_per_second", "last_event", "lag_seconds"]
    rows = [(i, *[r[c] for c in names[1:]]) for i, r in enumerate(reports)]
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))


@query
def stream_apply_latest(spark, sf):
    """The latest event per user and table, kept over micro-batches that come in random order; an XID removes the row."""
    key, order = ("source_id", "schema_name", "table_name"), ("log_file", "log_pos")
    events = fx.table(spark, sf, "events")
    path = f"{checkpoint_root(spark)}/streams/events-{uuid.uuid4().hex}"
    events.repartition(5, F.xxhash64("event_id")).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = fx.change_log_of(stream).select(*key, *order, "kind", "size")
    store = _store(spark, "latest")
    table = LatestTable(store.path("table"), key, order, buckets=4, compact_every=2)
    _finish(upsert_stream(rows, table, F.col("kind") == "XID", store.path("checkpoint")))
    return table.read(spark, rows.schema)


@query
def stream_watermark(spark, sf):
    """The watermark kept over micro-batches of messages in random order, every 211th of which never gets done: the last batch's."""
    store = _store(spark, "watermark")
    done = _event_batches(spark, sf).where(F.col("event_id") % 211 != 210).select(
        F.when(F.col("event_id") % 2 == 0, "changes").otherwise("audit").alias("topic"),
        (floor_div(F.col("event_id"), 2) % fx.PARTITIONS).cast("int").alias("partition"),
        floor_div(F.col("event_id"), 2 * fx.PARTITIONS).alias("offset"),
    )
    _finish(watermark_stream(done, store, span=1000))
    marks = store.read(spark, "watermarks")
    last = marks.groupBy("topic", "partition").agg(F.max_by("watermark", "batch").alias("watermark"))
    return last.select("topic", "partition", "watermark")


def _ordered_batches(spark, sf, files):
    """The event table as a stream of micro-batches in order of the ids: one file after the other is written."""
    events = fx.table(spark, sf, "events")
    path = f"{checkpoint_root(spark)}/streams/events-{uuid.uuid4().hex}"
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    for i in range(files):
        first, end = (low + (high + 1 - low) * k // files for k in (i, i + 1))
        events.where((F.col("event_id") >= first) & (F.col("event_id") < end)).coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _event_batches(spark, sf, files=4):
    """The event table as a stream of several micro-batches."""
    events = fx.table(spark, sf, "events")
    path = f"{checkpoint_root(spark)}/streams/events-{uuid.uuid4().hex}"
    events.repartitionByRange(files, "event_id").write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_log_rows(spark, sf):
    """Topic to packs to the log sink, over several micro-batches: a line for every message."""
    store = _store(spark, "log")
    messages = fx.messages_of(_event_batches(spark, sf))
    _finish(
        pack_stream(messages, open_sink("log", {"path": store.root}), store.path("checkpoint"), PACK_COUNT, PACK_SIZE, PACK_TICK, span=fx.SPAN)
    )
    return spark.read.text(store.path("log") + "/batch=*").withColumnRenamed("value", "line")


@query
def stream_files_to_table(spark, sf):
    """Files as the source and a table as the sink of the relay."""
    store = _store(spark, "hop")
    messages = fx.messages_of(_event_batches(spark, sf))
    _finish(
        pack_stream(messages, open_sink("table", {"path": store.root}), store.path("checkpoint"), PACK_COUNT, PACK_SIZE, PACK_TICK, "archive", fx.SPAN)
    )
    return relay.unpack(store.read(spark, "packs")).select("topic", "key", _text("value"))


@query
def stream_segments_in_batches(spark, sf):
    """As ``stream_segments``, in several micro-batches that carry state."""
    return _stream_segments(spark, _event_batches(spark, sf))


@query
def stream_segments(spark, sf):
    """The replayer as a stream: out-of-order messages with a gap, released, cut and placed."""
    return _stream_segments(spark, _event_stream(spark, sf))


@query
def stream_segments_whole(spark, sf):
    """As ``stream_segments`` without a gap: every row is released, cut and placed."""
    return _stream_segments(spark, _event_stream(spark, sf), gap=False)


@query
def stream_segments_whole_in_batches(spark, sf):
    """As ``stream_segments_whole``, in micro-batches: segments go on over their borders."""
    return _stream_segments(spark, _event_batches(spark, sf), gap=False)


def _replayed_messages(events):
    return events.select(
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"),
        encode_envelope(F.col("event_id") + 1, F.array(F.col("props").cast("binary"))).cast("binary").alias("value"),
        (F.col("event_id") % fx.PARTITIONS).cast("int").alias("partition"),
        ((F.col("event_id") * 48271) % 2147483647).alias("offset"),
        (F.col("event_type") == "purchase").alias("committed"),
    )


def _stream_segments(spark, stream, gap=True):
    events = stream.where(F.col("event_id") % 6007 != 6006) if gap else stream
    store = _store(spark, "segments")
    _finish(resequence_stream(_replayed_messages(events), store, segment_limit=SEGMENT_LIMIT))
    return store.read(spark, "segments").select(
        "segment_id", "seqid", "size", "log_pos", "crc", F.col("frame").cast("string").alias("frame")
    )


@query
def stream_far_ahead(spark, sf):
    """The later half of the ids arrives first and waits by ranges, with messages delivered again: what each batch releases."""
    events, files = fx.table(spark, sf, "events"), 6
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    path = f"{checkpoint_root(spark)}/streams/events-{uuid.uuid4().hex}"
    for i in range(files):
        piece = (i + files // 2) % files
        first, end = (low + (high + 1 - low) * k // files for k in (piece, piece + 1))
        again = F.when(F.col("event_id") % 101 == 7, 2).otherwise(1)
        batch = events.where((F.col("event_id") >= first) & (F.col("event_id") < end)).withColumn("copy", F.explode(F.sequence(F.lit(1), again)))
        batch.drop("copy").coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = _store(spark, "released")
    _finish(resequence_stream(_replayed_messages(stream), store, span=1000))
    return store.read(spark, "released").select(F.col("batch").cast("bigint").alias("batch"), "seqid", "d", "key")


@query
def stream_tail_segments(spark, sf):
    """A reader that follows segments from a position on while they are written; half-way another one goes on from its place."""
    events, files = fx.table(spark, sf, "events"), 4
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    path = f"{checkpoint_root(spark)}/streams/events-{uuid.uuid4().hex}"
    store, log = _store(spark, "segments"), CommitLog(_store(spark, "segment-log").root)
    readers = [_store(spark, "tail"), _store(spark, "tail")]
    frames, start = _store(spark, "tail-frames"), (TAIL_SEGMENT, TAIL_POS)
    for i in range(files):
        first, end = (low + (high + 1 - low) * k // files for k in (i, i + 1))
        events.where((F.col("event_id") >= first) & (F.col("event_id") < end)).coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        _finish(resequence_stream(_replayed_messages(stream), store, segment_limit=SEGMENT_LIMIT, log=log))
        nr = i * len(readers) // files
        if nr and i * len(readers) % files == 0:
            start = position(spark, readers[nr - 1], i - 1)
        write = lambda df, batch_id, nr=nr: frames.write("read", batch_id * len(readers) + nr, df)
        _finish(tail_segments(spark, log, readers[nr], write, *start))
    return frames.read(spark, "read").select("segment_id", "seqid", "size", "log_pos", F.col("frame").cast("string").alias("frame"))


@query
def stream_segments_repaired(spark, sf):
    """Between two runs of the replayer frames of the last segment get damaged; the second one finds and rewrites them first."""
    events, files = fx.table(spark, sf, "events"), 4
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    path = f"{checkpoint_root(spark)}/streams/events-{uuid.uuid4().hex}"
    store, log = _store(spark, "segments"), CommitLog(_store(spark, "segment-log").root)
    for i in range(files):
        first, end = (low + (high + 1 - low) * k // files for k in (i, i + 1))
        events.where((F.col("event_id") >= first) & (F.col("event_id") < end)).coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
        if i % 2:
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
            _finish(resequence_stream(_replayed_messages(stream), store, segment_limit=SEGMENT_LIMIT, log=log))
        if i == 1:  # other rows in the place of the last batch's: some frames changed, and the last ones lost
            last = log.manifests(spark)[-1]
            rows = log.rows(spark, [last]).drop("batch")
            changed = F.when(F.col("seqid") % 3 == 0, F.concat(F.col("frame"), F.lit("!").cast("binary"))).otherwise(F.col("frame"))
            lost = (F.col("segment_id") == last.facts["segment"]) & (F.col("log_pos") == last.facts["pos"])
            log.replace(rows.where(~lost).withColumn("frame", changed), last)
    return log.read(spark).select("segment_id", "seqid", "size", "log_pos", "crc", F.col("frame").cast("string").alias("frame"))


@query
def stream_relay(spark, sf):
    """Topic to packs, over the hop with retries and a second way, and back to topic rows. Every batch is sent twice, as after a failure."""
    store = _store(spark, "relay")
    sent = CommitLog(store.path("packs"))
    stream = _event_stream(spark, sf).select(
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"),
        F.col("props").cast("binary").alias("value"),
        F.lit("changes").alias("topic"),
        (F.col("event_id") % fx.PARTITIONS).cast("int").alias("partition"),
        floor_div(F.col("event_id"), fx.PARTITIONS).alias("offset"),
        "ts",
    )
    hop = failover_write(commit_writer(sent), [commit_writer(sent)])

    def twice(df, batch_id):
        hop(df, batch_id)
        hop(df, batch_id)

    _finish(
        pack_stream(
            stream, retrying_write(twice, 3, 1.0), store.path("checkpoint-out"), PACK_COUNT, PACK_SIZE, PACK_TICK, span=fx.SPAN
        )
    )
    arrive = lambda packs, batch_id: table_writer(store, "topic")(relay.republish(packs, 6), batch_id)
    _finish(sent.follow_rows(spark, _store(spark, "relay-in"), arrive))
    return store.read(spark, "topic").select("topic", "key", _text("value"), "partition")
