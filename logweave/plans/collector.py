"""The collector: change events to numbered records to topic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.cyclic import MIN_SEQID
from logweave.functions.envelope import encode_envelope
from logweave.operators.routing import stable_key, topic_rows
from logweave.operators.rules import Rules
from logweave.operators.scan import BLOCK_SPAN
from logweave.operators.sequence import assign_seqid
from logweave.operators.transactions import ALONE_KEY, counted_parts, headers_of, with_payload
from logweave.session import cut_lineage


def numbered_headers(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    start: int = MIN_SEQID,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """Record headers with their ids. Headers are a small part of the log and numbering reads them
    several times, so they are written once in between."""
    parts, rows = counted_parts(events, rules, max_size, scope, span)
    headers = cut_lineage(headers_of(parts, scope, rows))
    return assign_seqid(headers, start, scope, span).drop(*ALONE_KEY)


def numbered_records(
    events: DataFrame,
    rules: Rules,
    max_size: int,
    start: int = MIN_SEQID,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
    payload: str = "raw",
) -> DataFrame:
    """The same with payload. Cutting and numbering see narrow rows only."""
    parts, rows = counted_parts(events, rules, max_size, scope, span)
    parts = cut_lineage(parts)
    headers = assign_seqid(cut_lineage(headers_of(parts, scope, rows)), start, scope, span)
    return payload_of(headers, parts, events, scope, payload)


def payload_of(
    numbered: DataFrame, parts: DataFrame, events: DataFrame, scope: Sequence[str] = ("source_id",), payload: str = "raw"
) -> DataFrame:
    """Numbered headers with their payload: ids meet the narrow event rows first, which then fetch it."""
    record = [*scope, "epoch", "part", *ALONE_KEY]
    wanted = parts.join(numbered.select(*record, "seqid"), record)
    return with_payload(wanted, events, scope, payload, more=["seqid"])


def record_topic_rows(records: DataFrame, topic: str, partitions: int, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Numbered records as envelopes under replayable keys: (topic, key, value, partition, seqid)."""
    key = stable_key(*[F.col(c) for c in scope], F.col("log_file"), F.col("log_pos"))
    value = encode_envelope(F.col("seqid"), F.col("data"))
    rows = topic_rows(records, F.lit(topic), value, partitions, key, keep=["seqid"])
    return rows.select("topic", "key", "value", "partition", "seqid")
