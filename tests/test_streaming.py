"""Streams cut into several micro-batches against the batch operators, with restarts in between."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.functions.envelope import encode_envelope
from logweave.operators import bookkeeping, relay, sequence, transactions
from logweave.plans import fixtures as fx
from logweave.plans.queries import RULES
from logweave.streaming.collector import collect_stream
from logweave.streaming.relay import failover_write, open_sink, open_source, pack_stream, republish_stream, retrying_write, table_writer
from logweave.streaming.replayer import resequence_stream
from logweave.streaming.state import BatchStore
from logweave.streaming.watermark import watermark_stream


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def in_files(df, folder, order, files):
    """Write ``df`` as that many files, in order, each one a micro-batch."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    for i in range(files):
        lo, hi = low + (high - low + 1) * i // files, low + (high - low + 1) * (i + 1) // files
        df.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(folder)


def test_collector_stream_equals_batch(spark, tmp_path):
    log = fx.change_log(spark, SF_SMALL)
    store = BatchStore(str(tmp_path / "store"))
    folder = str(tmp_path / "log")
    half = log.agg(F.max("log_pos")).first()[0] // 2
    # two batches, a stop, then two more from the checkpoint
    for piece in (log.where(F.col("log_pos") <= half), log.where(F.col("log_pos") > half)):
        in_files(piece, folder, "log_pos", 2)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run(collect_stream(stream, RULES, fx.MAX_SIZE, store, span=fx.SPAN))
    got = store.read(spark, "records")
    assert got.select("batch").distinct().count() == 4
    want = transactions.build_records(log, RULES, fx.MAX_SIZE, span=fx.SPAN)
    columns = ["source_id", "log_file", "log_pos", "n_events", "bytes", "committed", "data"]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    rows = got.orderBy("seqid").select("seqid", "batch", "source_id", "log_pos").collect()
    assert [r.seqid for r in rows] == list(range(1, len(rows) + 1))
    assert [r.batch for r in rows] == sorted(r.batch for r in rows)
    for source in {r.source_id for r in rows}:
        positions = [r.log_pos for r in rows if r.source_id == source]
        assert positions == sorted(positions)


def test_collector_state_holds_open_parts_only(spark, tmp_path):
    log = fx.change_log(spark, SF_SMALL)
    alone = log.where(F.col("kind").isin("OTHER", "ROWS") | ((F.col("kind") == "QUERY") & (F.upper(F.coalesce("query", F.lit(""))) != "BEGIN")))
    store = BatchStore(str(tmp_path / "store"))
    folder = str(tmp_path / "log")
    in_files(alone, folder, "log_pos", 3)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run(collect_stream(stream, RULES, fx.MAX_SIZE, store, span=fx.SPAN))
    assert store.read(spark, "records").select("batch").distinct().count() == 3
    assert all(store.previous(spark, "held_events", batch, log.schema).count() == 0 for batch in (2, 3))


def test_a_transaction_over_many_batches_is_cut_once(spark, tmp_path, monkeypatch):
    """Twelve batches, one transaction through nearly all of them; short ones of a second source beside it."""
    columns = "source_id bigint, log_file string, log_pos bigint, event_ts timestamp, kind string, schema_name string, table_name string, query string, size bigint, raw binary"
    ts, rows = datetime(2024, 1, 1), []

    def event(source, pos, kind, query=None, table="T1"):
        file = f"binlog-{pos // 70}.log"
        rows.append((source, file, pos, ts + timedelta(seconds=pos), kind, "DB0", table, query, 30 + pos % 11, f"{source}:{pos}".encode()))

    for step in range(100):
        long, short = step * 2, step * 2 + 1
        kind = {0: "QUERY", 1: "TABLE_MAP", 97: "XID", 98: "QUERY"}.get(step, "TABLE_MAP" if step % 23 == 5 else "ROWS")
        event(1, long, kind, "BEGIN" if step in (0, 98) else None, "T9" if step % 46 == 28 else "T1")
        event(2, short, ["QUERY", "TABLE_MAP", "ROWS", "XID", "ROTATE"][step % 5], "begin")
    log = spark.createDataFrame(rows, columns)
    store, folder = BatchStore(str(tmp_path / "store")), str(tmp_path / "log")
    in_files(log, folder, "log_pos", 12)
    routed = []
    keep = BatchStore.keep

    def counting(self, name, batch_id, df):
        keep(self, name, batch_id, df)
        if name == "routed":
            state = 0 if batch_id == 0 else spark.read.parquet(self._slot("state", batch_id - 1)).count()
            routed.append(spark.read.parquet(self._slot(name, batch_id)).count() - state)

    monkeypatch.setattr(BatchStore, "keep", counting)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run(collect_stream(stream, RULES, 200, store, span=64))
    assert len(routed) == 12 and sum(routed) == len([r for r in rows if r[4] != "ROTATE"])
    kept = ["source_id", "epoch", "part", "log_file", "log_pos", "n_events", "bytes", "first_file", "first_pos", "event_ts", "committed", "data"]
    want = transactions.build_records(log, RULES, 200, span=64).select(*kept).collect()
    got = store.read(spark, "records").select(*kept).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and max(r.part for r in want) > 5
    held = store.previous(spark, "held_events", 12, log.schema).collect()
    assert sum(r.size for r in held) <= 2 * 240


def test_replayed_batch_hands_out_the_same_ids(spark, tmp_path):
    log = fx.change_log(spark, SF_SMALL)
    store = BatchStore(str(tmp_path / "store"))
    folder = str(tmp_path / "log")
    in_files(log, folder, "log_pos", 2)
    calls = []

    def failing_once(records, batch_id):
        calls.append((batch_id, sorted(r.seqid for r in records.select("seqid").collect())))
        if len(calls) == 2:
            raise RuntimeError("sink is down")

    def stream():
        return collect_stream(
            spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder),
            RULES, fx.MAX_SIZE, store, span=fx.SPAN, sink=failing_once,
        )

    query = stream().trigger(availableNow=True).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    run(stream())
    assert [c[0] for c in calls] == [0, 1, 1]
    assert calls[1] == calls[2]
    ids = sorted(r.seqid for r in store.read(spark, "records").select("seqid").collect())
    assert ids == list(range(1, len(ids) + 1))


def test_resequenced_stream_equals_batch(spark, tmp_path):
    start = 10**12 - 300
    messages = fx.topic_messages(spark, SF_SMALL, "dups", start)
    junk = messages.where(F.col("value").cast("string") == "junk").count()
    # fill the holes the junk left, except the last one
    holes = fx.table(spark, SF_SMALL, "events").where((F.col("event_id") % 211 == 210) & (F.col("event_id") < 800))
    seqid = fx.seqid_at(start, F.col("event_id"))
    filler = holes.select(
        F.lit("f").alias("key"), encode_envelope(seqid, F.array(F.col("props").cast("binary"))).cast("binary").alias("value"),
        F.lit("changes").alias("topic"), F.lit(9).alias("partition"), (F.col("event_id") * 3).alias("arrival"), "ts",
        F.col("event_id").alias("offset"),
    )
    messages = messages.unionByName(filler).withColumn("committed", F.lit(True))
    store, folder = BatchStore(str(tmp_path / "store")), str(tmp_path / "topic")
    in_files(messages, folder, "arrival", 3)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run(resequence_stream(stream, store, start, segment_limit=1000))
    good, dead = relay.split_bad_envelopes(messages)
    want = [r.seqid for r in sequence.resequence(good, start).orderBy("d").select("seqid").collect()]
    got = store.read(spark, "released").orderBy("batch", "d").select("seqid").collect()
    assert [r.seqid for r in got] == want and len(want) == 843 and want[301] == 1
    assert store.read(spark, "dead").count() == junk > 0
    assert store.read(spark, "segments").count() == len(want)

    # segments: positions run on across batches, a cut comes right after a file passed the limit
    frames = store.read(spark, "segments").orderBy("segment_id", "log_pos").collect()
    segment, end = 0, 120
    for f in frames:
        if f.segment_id != segment:
            assert f.segment_id == segment + 1 and end > 1000
            segment, end = f.segment_id, 120
        else:
            assert end <= 1000 or end == 120
        assert f.log_pos == end + f.size
        end = f.log_pos
    assert segment > 3


def test_relay_round_trip(spark, tmp_path):
    messages = fx.ordered_messages(spark, SF_SMALL)
    folder = str(tmp_path / "topic")
    in_files(messages, folder, "offset", 2)
    packs = BatchStore(str(tmp_path / "hop"))
    stream = open_source(spark, "files", {"path": folder, "maxFilesPerTrigger": "1"}, messages.schema)
    run(pack_stream(stream, open_sink("table", {"path": packs.root}), packs.path("checkpoint"), 10, 200, 86400, span=fx.SPAN))
    schema = spark.read.parquet(packs.path("packs")).drop("batch").schema
    out = BatchStore(str(tmp_path / "out"))
    hop = spark.readStream.schema(schema).parquet(packs.path("packs") + "/batch=*")
    run(republish_stream(hop, table_writer(out, "topic"), out.path("checkpoint"), 6))
    got = out.read(spark, "topic").select("topic", "key", "value").collect()
    want = messages.select("topic", "key", "value").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    open_sink("log", {"path": packs.root})(spark.read.parquet(packs.path("packs")), 0)
    assert spark.read.text(packs.path("log", 0)).count() == len(want)
    with pytest.raises(ValueError):
        open_sink("tape", {})


def test_failing_sinks(spark):
    df = spark.range(5)
    seen = []

    def down(_, batch_id):
        raise OSError("primary")

    def up(d, batch_id):
        seen.append((batch_id, d.count()))

    def also_down(_, batch_id):
        raise ValueError("fallback")

    failover_write(up, [down])(df, 1)
    failover_write(down, [also_down, up])(df, 2)
    assert seen == [(1, 5), (2, 5)]
    with pytest.raises(OSError, match="primary"):
        failover_write(down, [also_down])(df, 3)
    with pytest.raises(OSError, match="primary"):
        failover_write(down, [])(df, 4)

    tries = []

    def third_time(d, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise OSError("busy")

    retrying_write(third_time, 5, 0)(df, 7)
    assert tries == [7, 7, 7]
    with pytest.raises(OSError):
        retrying_write(down, 2, 0)(df, 8)


def test_messages_delivered_again_go_out_once(spark, tmp_path):
    """Copies under one partition and offset: in one batch, over batches, and while the first one waits."""
    schema = "key string, value binary, topic string, partition int, offset bigint, committed boolean"

    def message(seqid):
        return (f"k{seqid}", f'{{"seqid":{seqid},"data":["eA=="]}}'.encode(), "changes", seqid % 3, 10 * seqid, True)

    batches = [[1, 2, 2, 3, 6], [4, 6, 3, 7, 6], [5, 2, 8, 8], [9, 7, 10]]
    store, folder = BatchStore(str(tmp_path / "store")), str(tmp_path / "topic")
    for ids in batches:
        spark.createDataFrame([message(i) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run(resequence_stream(stream, store, segment_limit=1000))
    got = [(r.batch, r.seqid) for r in store.read(spark, "released").orderBy("batch", "d").collect()]
    assert got == [(0, 1), (0, 2), (0, 3), (1, 4), (2, 5), (2, 6), (2, 7), (2, 8), (3, 9), (3, 10)]
    assert store.read(spark, "segments").count() == 10


def test_watermark_over_batches_in_random_order(spark, tmp_path):
    random = np.random.default_rng(7)
    schema = "topic string, partition int, offset bigint"
    offsets = [("a", 0, int(o)) for o in random.permutation(300)] + [("a", 1, int(o)) for o in random.permutation(300) if o % 50 != 49] + [("b", 0, int(o)) for o in range(5, 40)]
    rows = [offsets[i] for i in random.permutation(len(offsets))]
    rows[100:100] = rows[:40]  # done again
    store, folder = BatchStore(str(tmp_path / "store")), str(tmp_path / "done")
    for at in (0, 150, 400, 550):
        spark.createDataFrame(rows[at : {0: 150, 150: 400, 400: 550}.get(at)], schema).coalesce(1).write.mode("append").parquet(folder)
        run(watermark_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), store, span=16))
        seen = spark.read.schema(schema).parquet(folder)
        batch = store.read(spark, "watermarks").agg(F.max("batch")).first()[0]
        got = store.read(spark, "watermarks").where(F.col("batch") == batch).drop("batch")
        want = bookkeeping.contiguous_watermark(seen, 0, span=16)
        assert sorted(map(tuple, got.select("topic", "partition", "watermark").collect())) == sorted(map(tuple, want.select("topic", "partition", "watermark").collect()))
    runs = store.previous(spark, "runs", 4, bookkeeping.offset_intervals(seen).schema).groupBy("topic", "partition").count()
    assert {(r.topic, r.partition): r["count"] for r in runs.collect()} == {("a", 0): 1, ("a", 1): 6, ("b", 0): 1}
