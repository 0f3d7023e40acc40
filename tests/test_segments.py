"""Segment files and tables: round trips, damage, torn tails, replay."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from logweave.operators import lifecycle, segments
from logweave.plans import fixtures as fx
from logweave.sinks.segments import read_segments, write_segments
from logweave.sinks.topic import kafka_sink_options, write_topic_table
from logweave.operators import routing
from logweave.sources.segment_files import read_segment_files, verify_segment_files
from logweave.sources.topic import kafka_source_options, starting_offsets


def segment_bytes(bodies):
    out, ends = b"\0" * 4, [4]
    for i, body in enumerate(bodies):
        size = 19 + len(body) + 4
        frame = struct.pack("<IBIIIH", 1700000000 + i, 16, 7, size, ends[-1] + size, 0) + body
        out += frame + struct.pack("<I", zlib.crc32(frame))
        ends.append(len(out))
    return out, ends


def test_segment_files(spark, tmp_path):
    bodies = [b"x" * n for n in (5, 0, 40, 7, 13)]
    whole, ends = segment_bytes(bodies)
    flipped = bytearray(whole)
    flipped[ends[2] + 25] ^= 1
    files = {
        "binlog-100.log": whole, "binlog-101.log": bytes(flipped), "binlog-102.log": whole[: ends[4] + 11],
        "binlog-103.log": whole[: ends[4] + 25], "binlog-104.log": b"\0" * 4, "binlog-1.log.tmp": whole, "other.log": whole,
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    frames = read_segment_files(spark, str(tmp_path))
    got = frames.where(F.col("segment_file") == "binlog-100.log").orderBy("idx").collect()
    assert [r.log_pos for r in got] == ends[1:] and all(r.crc_ok for r in got)
    assert [bytes(r.frame[19:]) for r in got] == bodies
    verdict = {r.segment_file: (r.valid_end, r.stop_reason) for r in verify_segment_files(frames).collect()}
    assert verdict == {
        "binlog-100.log": (ends[5], "eof"), "binlog-101.log": (ends[2], "checksum"),
        "binlog-102.log": (ends[4], "eof"), "binlog-103.log": (ends[4], "eof"),
    }


def test_crc_check_value(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926


def test_damaged_frame_fails_the_read(spark):
    frames = fx.segment_frames(spark, SF_SMALL)
    with pytest.raises(Exception, match="checksum failed"):
        segments.replay_from(frames).collect()
    intact, damaged = segments.quarantine(frames)
    assert damaged.count() == 1 and segments.replay_from(intact).count() == frames.count() - 1


def test_segment_table_round_trip(spark, tmp_path):
    frames = fx.segment_frames(spark, SF_SMALL).withColumn("segment_id", F.floor(F.col("seqid") / 100).cast("bigint"))
    write_segments(frames, str(tmp_path / "t"), per_folder=4)
    assert read_segments(spark, str(tmp_path / "t"), per_folder=4).count() == frames.count()
    tail = read_segments(spark, str(tmp_path / "t"), from_segment=6, per_folder=4)
    assert tail.count() == frames.where("segment_id >= 6").count()
    assert "PartitionFilters: [isnotnull(segment_range" in tail._jdf.queryExecution().toString()
    ordered = segments.scan_segments(tail, 7, 0).select("segment_id", "log_pos").collect()
    assert ordered == sorted(ordered) and ordered[0].segment_id == 7


def test_start_positions(spark):
    frames = spark.createDataFrame([(1, 150, 30), (1, 200, 50), (2, 140, 20)], "segment_id bigint, log_pos bigint, size bigint")
    take = lambda *a: [(r.segment_id, r.log_pos) for r in segments.scan_segments(frames, *a).collect()]
    assert take() == take(1) == take(1, 0) == [(1, 150), (1, 200), (2, 140)]
    assert take(1, 150) == [(1, 200), (2, 140)] and take(2) == [(2, 140)]


def test_tiers(spark, tmp_path):
    day = 86400
    ages = [(0,), (day - 1,), (2 * day - 1,), (2 * day,), (4 * day - 1,), (4 * day,)]
    df = spark.createDataFrame(ages, "age bigint").withColumn("day", F.floor(F.col("age") / day))
    tiered = lifecycle.tier_by_age(df, F.lit(10**6) - F.col("age"), F.lit(10**6))
    assert [r.tier for r in tiered.orderBy("age").collect()] == ["hot", "hot", "hot", "compressed", "compressed", "expired"]
    lifecycle.write_tiers(tiered, str(tmp_path / "t"), "day")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.tier, r.age) for r in back.collect()} == {(r.tier, r.age) for r in tiered.where("tier <> 'expired'").collect()}


def test_key_lists(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"], ["1", "2"])], "k array<string>, v array<string>")
    rows = routing.topic_rows_of_lists(df, F.lit("t"), F.col("k"), F.col("v"), 3)
    assert [(r.idx, r.key, r.value) for r in rows.orderBy("idx").collect()] == [(0, "a", "1"), (1, "b", "2")]
    write_topic_table(rows, str(tmp_path / "topic"))
    assert spark.read.parquet(str(tmp_path / "topic")).count() == 2
    uneven = spark.createDataFrame([(["a"], ["1", "2"])], "k array<string>, v array<string>")
    with pytest.raises(Exception, match="differ in length"):
        routing.topic_rows_of_lists(uneven, F.lit("t"), F.col("k"), F.col("v"), 3).collect()
    random_keys = routing.topic_rows(df, F.lit("t"), F.col("v"), 3).first()
    assert len(random_keys.key) == 36 and 0 <= random_keys.partition < 3


def test_kafka_options():
    assert starting_offsets("t", {0: 7, 2: 9}, 3) == '{"t": {"0": 7, "1": -2, "2": 9}}'
    assert kafka_source_options("h:1", "t", {}, 1, 50)["maxOffsetsPerTrigger"] == "50"
    assert kafka_sink_options("h:1")["kafka.acks"] == "all" and kafka_sink_options("h:1")["kafka.compression.type"] == "gzip"
