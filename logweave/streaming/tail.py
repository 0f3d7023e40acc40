"""Tailing reader of a segment log: frames from a position on, across rotations, while more of them are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweave.operators.segments import HEAD_BYTES, check_on_read, scan_segments
from logweave.streaming.commits import CommitLog
from logweave.streaming.state import BatchStore

FIRST = {"segment": -1, "pos": HEAD_BYTES}


def commit_frames(log: CommitLog, frames: DataFrame, batch_id: int, **facts: int) -> None:
    """Commit placed frames (a stored table); the manifest names the place where they end, which readers skip batches by."""
    last = end_of(frames)
    log.commit(frames, batch_id, {} if last is None else {"segment": last.segment_id, "pos": last.log_pos, **facts})


def end_of(frames: DataFrame) -> Row | None:
    """(segment_id, log_pos) of the last frame."""
    return frames.agg(F.max(F.struct("segment_id", "log_pos")).alias("at")).first().at


def tail_segments(
    spark: SparkSession,
    log: CommitLog,
    store: BatchStore,
    write: Callable[[DataFrame, int], None],
    start_segment: int | None = None,
    start_pos: int = HEAD_BYTES,
    batches_per_trigger: int | None = None,
) -> DataStreamWriter:
    """A writer that hands on the frames of ``log`` from (segment, position) on, checked and in order, and follows what is committed later.

    No segment means the oldest, a position inside the head the start of the segment. State: the place up to which frames were handed
    on (:func:`position`). With the same ``store`` the reader goes on where it stopped; a new one that is given that place
    as its start gets exactly what follows. Batches that end before the start are skipped by their manifests.
    """

    def batch(session: SparkSession, manifests: list[Row], batch_id: int) -> None:
        first = FIRST if start_segment is None else {"segment": start_segment, "pos": max(start_pos, HEAD_BYTES)}
        at = store.previous_row(session, "position", batch_id, first)
        news = [m for m in manifests if m.facts and (m.facts["segment"], m.facts["pos"]) > (at.segment, at.pos)]
        end = {"segment": at.segment, "pos": at.pos}
        if news:
            frames = log.rows(session, news).drop("batch")
            write(check_on_read(scan_segments(frames, at.segment, at.pos)), batch_id)
            end = max((m.facts for m in news), key=lambda facts: (facts["segment"], facts["pos"]))
        store.keep_row(session, "position", batch_id, {"segment": end["segment"], "pos": end["pos"]})

    return log.follow(spark, store, batch, batches_per_trigger)


def position(spark: SparkSession, store: BatchStore, batch_id: int) -> tuple[int, int]:
    """(segment, position) a reader stands at after that batch."""
    at = store.previous_row(spark, "position", batch_id + 1, FIRST)
    return at.segment, at.pos
