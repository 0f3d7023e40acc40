"""Throughput, freshness and connected consumers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.integers import floor_div
from logweave.functions.times import epoch_seconds, rfc3339
from logweave.operators.scan import Scan, block_of, prefix_scan


def throughput(df: DataFrame, ts: str, interval_seconds: int, scope: Sequence[str] = ()) -> DataFrame:
    """Per interval: events so far and events per second, integer-divided; idle intervals report 0."""
    scope = list(scope)
    counts = df.groupBy(*scope, floor_div(epoch_seconds(F.col(ts)), interval_seconds).alias("slot")).agg(
        F.count("*").alias("n")
    )
    # first into days, then days over the cluster, so that no task spells out the whole history
    slots_per_day = max(86400 // interval_seconds, 1)
    bounds = counts.groupBy(*scope).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    day = lambda c: floor_div(F.col(c), slots_per_day)
    calendar = (
        bounds.withColumn("day", F.explode(F.sequence(day("lo"), day("hi"))))
        .repartition(*scope, "day")
        .withColumn(
            "slot",
            F.explode(
                F.sequence(
                    F.greatest("lo", F.col("day") * slots_per_day),
                    F.least("hi", F.col("day") * slots_per_day + slots_per_day - 1),
                )
            ),
        )
        .select(*scope, "day", "slot")
    )
    filled = calendar.join(counts, [*scope, "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return prefix_scan(
        filled, scope, [["day"]], ["slot"], [Scan("total", F.col("n"), inclusive=True)]
    ).select(
        *scope,
        (F.col("slot") * interval_seconds).alias("interval_start"),
        F.col("n").alias("events"),
        "total",
        F.expr(f"n div {interval_seconds}").alias("avg_per_second"),
    )


def freshness(events: DataFrame, now: Column, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Time of the last event of each source in log order, and how far it is behind ``now``."""
    per_file = events.groupBy(*scope, "log_file").agg(
        F.max("log_pos").alias("log_pos"), F.max_by(epoch_seconds(F.col("event_ts")), "log_pos").alias("seconds")
    )  # plain numbers: hashed, not sorted
    last = per_file.groupBy(*scope).agg(F.max(F.struct("log_file", "log_pos", "seconds")).alias("last"))
    seconds = F.col("last.seconds")
    return last.select(
        *scope, seconds.alias("last_event"), rfc3339(seconds).alias("last_event_text"), (now - seconds).alias("lag_seconds")
    )


def concurrency_gauge(sessions: DataFrame, order: str, delta: Column, span: int, scope: Sequence[str] = ()) -> DataFrame:
    """Running number of connected consumers; ``delta`` is +1, -1 or 0 per row."""
    blocked = sessions.withColumn("__block", block_of(F.col(order), span))
    return prefix_scan(
        blocked, scope, [["__block"]], [order], [Scan("connected", delta.cast("bigint"), inclusive=True)]
    ).drop("__block")
