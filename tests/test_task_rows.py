"""Rows of a task are bounded by their number, not by the session's number of shuffle partitions."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
from logweave.operators import scan
from logweave.operators.greedy import greedy_pack

SF_SMALL = "/root/testdata/sf0.001"


def per_task(df):
    tasks = df.withColumn("task", F.spark_partition_id()).collect()  # all columns, so that no step is left out
    return sorted(Counter(r.task for r in tasks).values())


def spread_out(spark, monkeypatch, name):
    """The query's rows as ever, and of each of its tasks when one takes about 100 rows. The session has 4 shuffle partitions."""
    query = __spark_entry__.queries()[name]
    expected = sorted(map(repr, query(spark, SF_SMALL).collect()))
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 100, raising=False)
    got = query(spark, SF_SMALL)
    assert sorted(map(repr, got.collect())) == expected
    return per_task(got)


def test_scans(spark, monkeypatch):
    tasks = spread_out(spark, monkeypatch, "fan_in")
    assert len(tasks) > 20 and tasks[-1] < sum(tasks) / 10


def test_a_scan_of_few_rows_keeps_the_sessions_partitions(spark):
    few = spark.range(50).withColumn("block", F.floor(F.col("id") / 10))
    ranked = scan.dense_rank_rows(few, [], [["block"]], ["id"])
    assert [r.rn for r in ranked.orderBy("id").collect()] == list(range(1, 51))
    assert len(per_task(ranked)) <= 4
    empty = scan.dense_rank_rows(few.where("id < 0"), [], [["block"]], ["id"])
    assert empty.collect() == []


def test_transactions(spark, monkeypatch):
    tasks = spread_out(spark, monkeypatch, "order_log_transactions")
    assert len(tasks) > 10 and tasks[-1] < sum(tasks) / 5


def test_records(spark, monkeypatch):
    tasks = spread_out(spark, monkeypatch, "order_log_records")
    assert len(tasks) > 10 and tasks[-1] < sum(tasks) / 5


def test_cutting(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 100, raising=False)
    rows = spark.range(3000).select("id", (F.col("id") % 1).alias("log"), F.floor(F.col("id") / 20).alias("block"), F.lit(1).cast("bigint").alias("size"))
    cut = greedy_pack(rows, ["log"], ["block"], ["id"], "size", max_size=9)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # so small a table would be sent to the blocks' entries
    try:
        tasks = per_task(cut)
    finally:
        spark.conf.set(threshold, before)
    assert len(tasks) > 20 and tasks[-1] < 500
    assert cut.where("is_cut").count() == 300
