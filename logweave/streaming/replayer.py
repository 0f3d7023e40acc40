"""Streaming replayer: messages in any order in, placed segment frames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweave.functions.cyclic import MIN_SEQID, cyclic_distance, next_seqid
from logweave.functions.envelope import total_bytes
from logweave.operators.bookkeeping import offset_intervals, watermark_of
from logweave.operators.relay import split_bad_envelopes
from logweave.operators.scan import ROW_SPAN, block_of
from logweave.operators.segments import HEADER_BYTES, rewrite_positions, segment_log, verify_segments
from logweave.operators.sequence import ahead_of, drop_stale
from logweave.streaming.commits import CommitLog
from logweave.streaming.shelf import Shelf
from logweave.streaming.state import BatchStore
from logweave.streaming.tail import commit_frames, end_of

NO_FRAMES = "segment_id bigint, d bigint, seqid bigint, idx int, frame binary, size bigint, log_pos bigint, crc bigint"


def resequence_stream(
    messages: DataFrame,
    store: BatchStore,
    start: int = MIN_SEQID,
    span: int = ROW_SPAN,
    segment_limit: int | None = None,
    log: CommitLog | None = None,
) -> DataStreamWriter:
    """A writer that releases messages in id order to ``store``'s "released", batch by batch.

    State: the expected id, the runs of ids that arrived ("runs", a row for each hole) and the messages behind the first
    gap, on a :class:`Shelf` by ranges of ``span`` ids. A batch adds its own messages and reads the ranges that it releases from,
    so what waits far behind a gap costs nothing until the gap is filled. A gap that never fills
    keeps everything behind it pending, as it must; "runs" names it.
    Messages delivered again, in one batch, over batches or while their first delivery waits, go out once.
    Undecodable messages go to "dead". With ``segment_limit`` the released records are also laid out
    as frames in "segments"; the open segment's number and bytes are state as well. A segment that the
    last record of a batch has closed stays closed: the next batch starts a new one, wherever batches end.
    With ``log`` the frames are committed there too, for readers that follow it (:mod:`logweave.streaming.tail`). Each start of the stream
    verifies the log's last segment before it appends to it, see :func:`repair_tail`.
    """
    shelf = Shelf(store.path("shelf"), span)
    first = {"seqid": start, "released": 0, "segment_id": 0, "segment_bytes": 0}
    verified = log is None or segment_limit is None

    def batch(new: DataFrame, batch_id: int) -> None:
        nonlocal verified
        spark = new.sparkSession
        if not verified:
            repair_tail(spark, log, store, segment_limit, span)
            verified = True
        good, dead = split_bad_envelopes(new)
        store.write("dead", batch_id, dead)
        state = store.previous_row(spark, "expected", batch_id, first)
        shelf.forget(spark, state.released)
        ahead = ahead_of(good, state.seqid).withColumn("at", cyclic_distance(F.col("seqid"), state.seqid) + state.released)
        ahead = store.between("ahead", batch_id, ahead)  # decoded once
        shelf.add(ahead, batch_id)

        single = [F.lit(0).alias("partition"), F.col("at").alias("low"), F.col("at").alias("high")]
        arrived = store.between("arrived", batch_id, ahead.select(*single))
        before = store.previous(spark, "runs", batch_id, arrived.schema)
        united = offset_intervals(before.unionByName(arrived), span).select(*arrived.columns)
        runs = store.between("runs", batch_id, united.where(F.col("high") >= state.released))
        last = watermark_of(runs, state.released).agg(F.max("watermark")).first()[0]
        last = state.released - 1 if last is None else last
        count = last + 1 - state.released
        # no id of these is missing, so each id's first message can go
        ready = drop_stale(shelf.between(spark, ahead.schema, state.released, last), state.seqid)
        store.write("released", batch_id, ready.withColumn("d", F.col("at") - state.released).select("d", *good.columns))

        segment_id, segment_bytes = state.segment_id, state.segment_bytes
        if segment_limit is not None and count:
            released = spark.read.parquet(store.path("released", batch_id))
            frames = _place(released, segment_id, segment_bytes, segment_limit, span)
            store.write("segments", batch_id, frames)
            written = spark.read.parquet(store.path("segments", batch_id))
            segment_id = written.agg(F.max("segment_id")).first()[0]
            log_pos = written.where(F.col("segment_id") == segment_id).agg(F.max("log_pos")).first()[0]
            committed = released.where(F.col("d") == count - 1).select("committed").first()[0]
            segment_bytes = log_pos - HEADER_BYTES
            if committed and log_pos > segment_limit:
                segment_id, segment_bytes = segment_id + 1, 0
            if log is not None:
                commit_frames(log, written, batch_id, open_segment=segment_id, open_bytes=segment_bytes)
        elif log is not None:
            log.commit(spark.createDataFrame([], NO_FRAMES), batch_id)
        store.keep_row(
            spark,
            "expected",
            batch_id,
            {
                "seqid": next_seqid(state.seqid, count), "released": last + 1,
                "segment_id": segment_id, "segment_bytes": segment_bytes,
            },
        )

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", store.path("checkpoint"))


def repair_tail(
    spark: SparkSession, log: CommitLog, store: BatchStore, segment_limit: int, span: int = ROW_SPAN, from_segment: int | None = None
) -> list[int]:
    """Verify the last segment of ``log``, or all from ``from_segment`` on, and write batches again that hold damaged frames of it.

    A batch is damaged if a frame fails its checksum or its last segment ends before the place that the manifest names. Its ids are
    read again from ``store``'s "released" and placed from where the batch before it ended, so every frame comes to stand
    where it stood: readers ahead of the damage miss nothing and see nothing twice. The damaged folder stays aside.
    Only batches that reach into these segments are read. Returns the batches written again; none for an intact or empty log.
    """
    placed = [m for m in log.manifests(spark) if m.facts]
    if not placed:
        return []
    oldest = placed[-1].facts["segment"] if from_segment is None else from_segment
    tail = [m for m in placed if m.facts["segment"] >= oldest]
    if not tail:
        return []
    frames = log.rows(spark, tail).where(F.col("segment_id") >= oldest)
    found = verify_segments(frames, ["batch", "segment_id"]).collect()  # a row for each segment and batch of the tail
    ends = {(r.batch, r.segment_id): r for r in found}
    damaged = {r.batch for r in found if r.stop_reason == "checksum"}
    for m in tail:
        end = ends.get((m.batch, m.facts["segment"]))
        if end is None or end.valid_end < m.facts["pos"]:
            damaged.add(m.batch)
    for before, m in zip([None, *placed], placed):
        if m.batch in damaged:
            released = spark.read.parquet(store.path("released", m.batch))
            at = (before.facts["open_segment"], before.facts["open_bytes"]) if before else (0, 0)
            log.replace(_place(released, *at, segment_limit, span), m)
            (again,) = log.manifests(spark, m.batch, m.batch)
            end = end_of(log.rows(spark, [again]))
            if end is None or (end.segment_id, end.log_pos) != (m.facts["segment"], m.facts["pos"]):
                raise ValueError(f"batch {m.batch} of {log.root} can't be written again: it does not end where it ended")
    return sorted(damaged)


def _place(released: DataFrame, segment_id: int, segment_bytes: int, limit: int, span: int) -> DataFrame:
    """Cut released records into segments that continue the open one, and place their frames.

    What the open segment already holds enters as one record ahead of the first, and leaves again.
    """
    spark = released.sparkSession
    sized = released.select("d", total_bytes(F.col("data")).alias("bytes"), F.col("committed"))
    held = spark.createDataFrame([(-1, segment_bytes, False)], sized.schema)
    cut = segment_log(sized.unionByName(held), limit, order="d", span=span)
    cut = cut.select("d", (F.col("segment_id") + segment_id).alias("segment_id"))
    frames = (
        released.select("d", "seqid", "data")
        .join(cut, "d")
        .select("segment_id", "d", "seqid", F.posexplode("data").alias("idx", "frame"))
        .withColumn("size", F.octet_length("frame").cast("bigint"))
    )
    open_frame = spark.createDataFrame([(segment_id, -1, 0, 0, None, segment_bytes)], frames.schema)
    placed = rewrite_positions(frames.unionByName(open_frame), ["d", "idx"], block_of(F.col("d"), span))
    return placed.where(F.col("d") >= 0)
