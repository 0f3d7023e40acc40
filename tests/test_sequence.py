"""Numbering, re-sequencing and watermarks against plain Python on random streams."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.cyclic import CYCLE, MAX_SEQID, cyclic_distance, next_seqid, seqid_at
from logweave.operators import bookkeeping, sequence
from logweave.operators.scan import Scan, prefix_scan


def test_cycle_arithmetic(spark):
    half = CYCLE // 2
    cases = [(1, 1, 0), (1, MAX_SEQID, 1), (MAX_SEQID, 1, CYCLE - 1), (half + 1, 1, half), (half + 2, 2, half), (half, 1, half - 1)]
    df = spark.createDataFrame(cases, "a bigint, b bigint, d bigint")
    assert df.where(cyclic_distance(F.col("a"), F.col("b")) != F.col("d")).count() == 0
    assert df.where(seqid_at(F.col("b"), F.col("d")) != F.col("a")).count() == 0
    assert next_seqid(MAX_SEQID) == 1 and next_seqid(MAX_SEQID - 1, 3) == 2
    # exactly half a cycle ahead still counts as ahead
    at_half = spark.createDataFrame([(seq, 0, i) for i, seq in enumerate([half, half + 1, half + 2])], "seqid bigint, partition int, offset bigint")
    assert [r.seqid for r in sequence.drop_stale(at_half, 1).orderBy("seqid").collect()] == [half, half + 1]


@pytest.mark.parametrize("seed", range(3))
def test_resequence(spark, seed):
    rng = random.Random(seed)
    start = MAX_SEQID - rng.randint(0, 400)
    distances = [d for d in range(600) if rng.random() > (0.004 if seed else 0)]
    distances += rng.choices(distances, k=100) + [-rng.randint(1, 50) for _ in range(40)]
    rng.shuffle(distances)
    rows = [((start - 1 + d) % CYCLE + 1, rng.randint(0, 2), i) for i, d in enumerate(distances)] + [(None, 0, -1), (0, 0, -2), (MAX_SEQID + 1, 0, -3)]
    messages = spark.createDataFrame(rows, "seqid bigint, partition int, offset bigint")

    best = {}
    for seq, part, off in rows[: len(distances)]:
        d = (seq - start) % CYCLE
        if d <= CYCLE // 2 and (d not in best or (part, off) < best[d]):
            best[d] = (part, off)
    gap = next(d for d in range(len(best) + 1) if d not in best)

    for span in (16, 1 << 20):
        got = sequence.resequence(messages, start, span).orderBy("d").collect()
        assert [(r.d, r.partition, r.offset) for r in got] == [(d, *best[d]) for d in range(gap)]
    status = {(r.partition, r.offset): r.status for r in sequence.message_status(messages, start, 50, 16).collect()}
    want = {(p, o): "invalid" if seq is None or not 1 <= seq <= MAX_SEQID else "duplicate" for seq, p, o in rows}
    for d, at in best.items():
        want[at] = "released" if d < gap else "pending" if d < gap + 50 else "blocked"
    assert status == want

    missing = set(range(max(best))) - set(best)
    report = sequence.gap_report(messages, start, 16).collect()
    covered = {d for r in report for d in range((r.first_missing - start) % CYCLE, (r.last_missing - start) % CYCLE + 1)}
    assert covered == missing and sum(r.missing for r in report) == len(missing)


def test_one_id_copied_very_often(spark):
    """Most of the topic is copies of one id."""
    ids = spark.range(100).select((F.col("id") + 1).alias("seqid"), F.lit(0).alias("partition"), "id")
    copies = spark.range(20000).select(F.lit(5).cast("bigint").alias("seqid"), F.lit(1).alias("partition"), (F.col("id") + 1000).alias("id"))
    messages = ids.unionByName(copies).withColumnRenamed("id", "offset")
    assert sequence.resequence(messages, 1, 16).count() == 100
    assert sequence.drop_stale(messages, 1).where(F.col("seqid") == 5).collect()[0].partition == 0


def test_watermark(spark):
    """Every offset of 1..1000 but one, in random order; copies do not matter."""
    rng = random.Random(4)
    offsets = list(range(1, 1001)) + rng.choices(range(1, 1001), k=200)
    rng.shuffle(offsets)
    rows = [(0, o) for o in offsets] + [(1, o) for o in offsets if o != 617] + [(2, o) for o in offsets if o != 1] + [(3, 0)]
    done = spark.createDataFrame(rows, "partition int, offset bigint")
    got = {r.partition: r.watermark for r in bookkeeping.contiguous_watermark(done, 1, span=64).collect()}
    assert got == {0: 1000, 1: 616}


def test_seqid_keeps_log_order_when_the_clock_steps_back(spark):
    rows = [(s, "f", p, 1000 - p if s else p * 70) for s in range(3) for p in range(100)]
    records = spark.createDataFrame(rows, "source_id bigint, log_file string, log_pos bigint, t bigint").withColumn("event_ts", F.timestamp_seconds("t"))
    got = sequence.assign_seqid(records, MAX_SEQID - 49, span=8).collect()
    order = sorted(got, key=lambda r: (r.seqid - (MAX_SEQID - 49)) % CYCLE)
    assert [(r.seqid - (MAX_SEQID - 49)) % CYCLE for r in order] == list(range(300))
    for s in range(3):
        assert [r.log_pos for r in order if r.source_id == s] == list(range(100))


@pytest.mark.parametrize("span", [1, 5, 1000])
def test_prefix_scan(spark, span):
    rng = random.Random(span)
    rows = [(s, i, rng.choice([None, rng.randint(-5, 9)])) for s in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "s int, i bigint, v bigint").orderBy(F.rand(1))
    df = df.withColumns({"coarse": F.floor(F.col("i") / 50).cast("bigint"), "fine": F.floor(F.col("i") / span).cast("bigint")})
    got = prefix_scan(
        df, ["s"], [["coarse"], ["fine"]], ["i"],
        [
            Scan("total", F.col("v"), inclusive=True), Scan("before", F.col("v")), Scan("top", F.col("v"), "max", inclusive=True),
            Scan("latest", F.col("v"), "last", default=-99), Scan("n", F.lit(1), inclusive=True),
        ],
    ).orderBy("s", "i").collect()
    assert len(got) == len(rows)
    for r in got:
        upto = [v for s, i, v in rows if s == r.s and i <= r.i]
        known = [v for v in upto if v is not None]
        earlier = [v for v in upto[:-1] if v is not None]
        assert (r.total, r.before, r.n) == (sum(known), sum(earlier), len(upto))
        assert r.top == (max(known) if known else None)
        assert r.latest == (earlier[-1] if earlier else -99)


def test_topic_without_a_gap_is_released_whole(spark):
    from logweave.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert events > 6006
    assert QUERIES["resequence_whole"](spark, sf).count() == events
    assert QUERIES["resequence"](spark, sf).count() < 6006
