"""Transactions and records from routed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.greedy import greedy_pack
from logweave.operators.rules import COMMIT, ROW_LIKE, Rules, classify, counted_routes, route_events
from logweave.operators.scan import BLOCK_SPAN, spread

# sets standalone events of one epoch apart
ALONE_KEY = ("alone_file", "alone_pos")
ALONE = -1


def position(file: str = "log_file", pos: str = "log_pos") -> Column:
    return F.struct(F.col(file).alias("log_file"), F.col(pos).alias("log_pos"))


def assemble_transactions(
    events: DataFrame, rules: Rules, scope: Sequence[str] = ("source_id",), span: int = BLOCK_SPAN
) -> DataFrame:
    """One row per committed transaction with something to replicate: (scope, epoch, n_events, bytes,
    first/last position). Counts and extremes only, so partial aggregation absorbs a huge transaction."""
    routed, rows = _routed(events, rules, scope, span)
    inside = routed.where(F.col("action").isin("tx", "commit"))
    # first inside the blocks, where the rows already are, then across them
    local = inside.groupBy(*scope, "log_file", "block", "epoch").agg(
        F.count("*").alias("n_events"),
        F.sum("size").alias("bytes"),
        F.min("log_pos").alias("first_pos"),
        F.max("log_pos").alias("last_pos"),
        F.max((F.col("action") == "commit").cast("int")).alias("committed"),
    )
    grouped = spread(local, [*scope, "epoch"], rows).groupBy(*scope, "epoch").agg(
        F.sum("n_events").alias("n_events"),
        F.sum("bytes").alias("bytes"),
        F.min(position(pos="first_pos")).alias("first"),
        F.max(position(pos="last_pos")).alias("last"),
        F.max("committed").alias("committed"),
    )
    return drop_empty(grouped, F.col("n_events"), F.col("committed") == 1).select(
        *scope,
        "epoch",
        "n_events",
        "bytes",
        F.col("first.log_file").alias("first_file"),
        F.col("first.log_pos").alias("first_pos"),
        F.col("last.log_file").alias("last_file"),
        F.col("last.log_pos").alias("last_pos"),
    )


def drop_empty(transactions: DataFrame, n_events: Column, committed: Column) -> DataFrame:
    """Keep committed transactions with at least two kept events besides the commit."""
    return transactions.where(committed & (n_events >= 3))


def split_transactions(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """Events of transactions with ``part`` and ``is_cut``: a part closes after the row event that takes
    it over ``max_size`` bytes; the commit goes with the last part. Carries no payload."""
    parts = record_parts(events, rules, max_size, scope, span)
    return parts.where(F.col("part") >= 0).select(*scope, "epoch", "log_file", "log_pos", "size", "part", "is_cut")


def _routed(events: DataFrame, rules: Rules, scope: Sequence[str], span: int) -> tuple[DataFrame, int]:
    """Events with their action, reduced to a mark and a few numbers before they are shuffled, and their number."""
    return counted_routes(marked_events(events, rules, scope), scope, span)


def marked_events(events: DataFrame, rules: Rules, scope: Sequence[str]) -> DataFrame:
    """Events without names and text, which their mark stands for."""
    described = events.where(~F.col("kind").isin("ROTATE", "FORMAT"))
    return classify(described, rules).select(*scope, "log_file", "log_pos", "event_ts", "size", "mark")


def standalone_events(
    events: DataFrame, rules: Rules, scope: Sequence[str] = ("source_id",), span: int = BLOCK_SPAN
) -> DataFrame:
    """Events outside any transaction that become records of their own."""
    return route_events(events, rules, scope, span).where(F.col("action") == "standalone").drop("block")


def record_headers(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """Every record the collector emits, without payload.

    (scope, epoch, part, n_events, bytes, first_*, log_file, log_pos, event_ts, committed); the position is
    that of the event that made the record go out. Standalone events have part -1. Parts of a
    still open transaction are out as soon as they are cut; the rest waits for the commit.
    """
    parts, rows = counted_parts(events, rules, max_size, scope, span)
    return headers_of(parts, scope, rows).drop(*ALONE_KEY)


def record_parts(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """Every event that belongs to a record, under its record's key (scope, epoch, part, alone_file,
    alone_pos). Narrow: no payload."""
    return counted_parts(events, rules, max_size, scope, span)[0]


def counted_parts(events: DataFrame, rules: Rules, max_size: int, scope: Sequence[str], span: int) -> tuple[DataFrame, int]:
    """:func:`record_parts` and a number that its rows don't exceed."""
    routed, rows = _routed(events, rules, scope, span)
    return parts_of_routed(routed, max_size, list(scope), rows), rows


def parts_of_routed(routed: DataFrame, max_size: int, scope: list[str], rows: int | None = None) -> DataFrame:
    """:func:`record_parts` of ``rows`` events that have their action already."""
    # Standalone events ride along: they weigh nothing and cannot be cut at, so they do not disturb the
    # transactions around them.
    alone = F.col("action") == "standalone"
    going = routed.where(F.col("action") != "drop").select(
        *scope,
        "log_file",
        "block",
        "log_pos",
        "event_ts",
        "size",
        "epoch",
        F.when(alone, 0).otherwise(F.col("size")).cast("bigint").alias("weight"),
        ((F.col("action") == "tx") & (F.col("mark") == ROW_LIKE)).alias("is_row"),
        F.when(alone, ALONE).otherwise(F.col("mark")).cast("tinyint").alias("mark"),
    )
    parts = greedy_pack(
        going, scope, ["log_file", "block"], ["log_pos"], "weight", max_size=max_size, eligible="is_row", run="epoch", rows=rows
    )
    # a standalone event shares (epoch, part) with its neighbours: its position sets it apart
    alone = F.col("mark") == ALONE
    return parts.select(
        *scope,
        "epoch",
        F.when(alone, -1).otherwise(F.col("part")).alias("part"),
        F.when(alone, F.col("log_file")).otherwise("").alias("alone_file"),
        F.when(alone, F.col("log_pos")).otherwise(-1).alias("alone_pos"),
        "log_file",
        "log_pos",
        "event_ts",
        "size",
        (F.col("mark") == COMMIT).alias("is_commit"),
        "is_cut",
    )


def headers_of(parts: DataFrame, scope: Sequence[str] = ("source_id",), rows: int | None = None) -> DataFrame:
    """Records that go out, from :func:`record_parts`, with their key. With ``rows``, the most rows that there are, the number of tasks
    goes by it. A part is bounded, so its rows may meet before they are folded."""
    record = [*scope, "epoch", "part", *ALONE_KEY]
    parts = parts if rows is None else spread(parts, record, rows)
    # by file first: plain numbers fold in place, positions are compared on what is left
    by_file = parts.groupBy(*record, "log_file").agg(
        F.count("*").alias("n_events"),
        F.sum("size").alias("bytes"),
        F.min("log_pos").alias("first_pos"),
        F.max("log_pos").alias("last_pos"),
        F.max("event_ts").alias("event_ts"),
        F.max(F.col("is_commit").cast("int")).alias("commit"),
        F.max(F.col("is_cut").cast("int")).alias("cut"),
    )
    whole = by_file.groupBy(*record).agg(
        F.sum("n_events").alias("n_events"),
        F.sum("bytes").alias("bytes"),
        F.min(position(pos="first_pos")).alias("first"),
        F.max(position(pos="last_pos")).alias("last"),
        F.max("event_ts").alias("event_ts"),
        F.max("commit").alias("commit"),
        F.max("cut").alias("cut"),
    )
    return _going_out(whole, record)


def _going_out(whole: DataFrame, record: Sequence[str], *more: str) -> DataFrame:
    """Standalone events and cut parts are out at once; a commit sends the last part unless the
    transaction is empty."""
    last_part = (F.col("commit") == 1) & ((F.col("part") > 0) | (F.col("n_events") >= 3))
    return whole.where((F.col("part") < 0) | (F.col("cut") == 1) | last_part).select(
        *record,
        "n_events",
        "bytes",
        F.col("first.log_file").alias("first_file"),
        F.col("first.log_pos").alias("first_pos"),
        F.col("last.log_file").alias("log_file"),
        F.col("last.log_pos").alias("log_pos"),
        "event_ts",
        (F.col("commit") == 1).alias("committed"),
        *more,
    )


def with_payload(
    parts: DataFrame, events: DataFrame, scope: Sequence[str] = ("source_id",), payload: str = "raw", more: Sequence[str] = ()
) -> DataFrame:
    """Records with ``data``, their events' payload in order; columns ``more`` are constant per record.

    The payload is shuffled twice, to its event and to its record. A record holds at most ``max_size``
    bytes plus the event that crossed the limit and what its statements add, so its array is bounded.
    """
    record = [*scope, "epoch", "part", *ALONE_KEY]
    place = [*scope, "log_file", "log_pos"]
    whole = (
        parts.join(events.select(*place, payload), place)
        .groupBy(*record, *more)
        .agg(
            F.count("*").alias("n_events"),
            F.sum("size").alias("bytes"),
            F.min(position()).alias("first"),
            F.max(position()).alias("last"),
            F.max("event_ts").alias("event_ts"),
            F.max(F.col("is_commit").cast("int")).alias("commit"),
            F.max(F.col("is_cut").cast("int")).alias("cut"),
            F.array_sort(F.collect_list(F.struct("log_file", "log_pos", payload))).alias("in_order"),
        )
    )
    data = F.transform("in_order", lambda e: e[payload])
    return _going_out(whole.withColumn("data", data), record, "data", *more)


def build_records(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
    payload: str = "raw",
) -> DataFrame:
    """Record headers plus ``data``, the record's events in order."""
    parts = record_parts(events, rules, max_size, scope, span)
    return with_payload(parts, events, scope, payload).drop(*ALONE_KEY)
