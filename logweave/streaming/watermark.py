"""Streaming watermark: up to where every offset is done, whatever order they get done in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from logweave.operators.bookkeeping import offset_intervals, watermark_of
from logweave.operators.relay import message_scope
from logweave.operators.scan import ROW_SPAN
from logweave.streaming.state import BatchStore


def watermark_stream(done: DataFrame, store: BatchStore, start: int = 0, span: int = ROW_SPAN) -> DataStreamWriter:
    """A writer that keeps the runs of done offsets as ``store``'s state "runs" and puts out "watermarks" per batch.

    The state of a partition is one row for each hole; offsets done twice, in one batch or in several, change nothing,
    and a replayed batch gives the same state again.
    """

    def batch(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        fresh = offset_intervals(new.select(*message_scope(new), "offset"), span)
        before = store.previous(spark, "runs", batch_id, fresh.schema)
        runs = store.between("runs", batch_id, offset_intervals(before.unionByName(fresh), span).select(*fresh.columns))
        store.write("watermarks", batch_id, watermark_of(runs, start))

    return done.writeStream.foreachBatch(batch).option("checkpointLocation", store.path("checkpoint"))
