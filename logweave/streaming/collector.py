"""Streaming collector: change events in, numbered records out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from logweave.functions.cyclic import MIN_SEQID, next_seqid
from logweave.operators.resume import headers_after, held_parts, no_state, parts_after, routed_after, state_after
from logweave.operators.rules import Rules
from logweave.operators.scan import BLOCK_SPAN
from logweave.operators.sequence import assign_seqid
from logweave.plans.collector import payload_of
from logweave.sources.changelog import read_changelog
from logweave.streaming.figures import LiveFigures
from logweave.streaming.ledger import IdLedger
from logweave.streaming.state import BatchStore

PART = "epoch bigint, part bigint, alone_file string, alone_pos bigint, is_commit boolean, is_cut boolean"


def collect_stream(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    store: BatchStore,
    start: int = MIN_SEQID,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
    sink: Callable[[DataFrame, int], None] | None = None,
    ledger: IdLedger | None = None,
    owner: str = "",
    figures: LiveFigures | None = None,
) -> DataStreamWriter:
    """A writer that turns each micro-batch of events into records under ``store``'s "records".

    State between batches: a row per source that routing and cutting follow on ("state", see
    :mod:`logweave.operators.resume`), the events of its open part ("held", at most ``max_size`` bytes and what
    statements add) and the id counter. Every event is routed and cut in its own batch only; epochs and parts count
    through the whole log. A record goes out in the batch that brings its last event, so none goes out twice.
    Events must arrive in log order per source from batch to batch. ``sink`` gets the numbered
    records too, before the batch is committed. With ``ledger`` the ids are ranges of a counter that several collectors
    share; ``owner`` names this one there, and a replayed batch gets the range it had. ``figures`` are told how many events each batch took.
    """
    scope = list(scope)
    place = [*scope, "log_file", "log_pos"]
    writer = events.writeStream

    def batch(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        state = store.previous(spark, "state", batch_id, no_state(new, scope).schema)
        narrow = StructType([*new.select(*place, "event_ts", "size").schema, *StructType.fromDDL(PART)])
        held = store.previous(spark, "held", batch_id, narrow)
        held_events = store.previous(spark, "held_events", batch_id, new.schema)
        counter = store.previous_row(spark, "counter", batch_id, {"next_seqid": start}).next_seqid
        fresh = read_changelog(new, state, scope)
        if figures is None:
            fresh = store.between("fresh", batch_id, fresh)
        else:
            fresh, seen = figures.observed(fresh)
            fresh = store.between("fresh", batch_id, fresh)
            figures.took(batch_id, seen)

        routed = store.between("routed", batch_id, routed_after(fresh, state, rules, scope, span))
        parts = store.between("parts", batch_id, parts_after(routed, state, max_size, scope).select(*narrow.names))
        headers = store.between("headers", batch_id, headers_after(held, parts, scope))
        waiting, whole = held.unionByName(parts), held_events.unionByName(fresh)
        if ledger is not None:
            counter = ledger.claim(spark, owner, batch_id, headers.count())
        numbered = assign_seqid(headers, counter, scope, span)
        store.write("records", batch_id, payload_of(numbered, waiting, whole, scope))
        records = spark.read.parquet(store.path("records", batch_id))
        if sink is not None:
            sink(records, batch_id)

        after = store.between("state", batch_id, state_after(routed, waiting, state, scope))
        still = store.between("held", batch_id, held_parts(waiting, after, scope))
        store.keep("held_events", batch_id, whole.join(still.select(*place), place, "left_semi").select(*new.columns))
        store.keep_row(spark, "counter", batch_id, {"next_seqid": next_seqid(counter, records.count())})

    return writer.foreachBatch(batch).option("checkpointLocation", store.path("checkpoint"))
