"""JSON envelopes. Spark's JSON writer already turns BINARY into base64 and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats.
ENVELOPE_SCHEMA = "seqid bigint, data array<binary>"
PACK_SCHEMA = "topic string, data array<struct<key:string,value:binary>>"


def encode_envelope(seqid: Column, data: Column) -> Column:
    return F.to_json(F.struct(seqid.cast("bigint").alias("seqid"), data.alias("data")))


def decode_envelope(value: Column) -> Column:
    """Struct of (seqid, data); null fields when the value is not a proper envelope."""
    return F.from_json(value.cast("string"), ENVELOPE_SCHEMA)


def encode_pack(topic: Column, data: Column) -> Column:
    return F.to_json(F.struct(topic.alias("topic"), data.alias("data")))


def decode_pack(pack: Column) -> Column:
    return F.from_json(pack.cast("string"), PACK_SCHEMA)


def total_bytes(data: Column) -> Column:
    """Bytes held by an array of byte strings."""
    return F.aggregate(data, F.lit(0).cast("bigint"), lambda acc, x: acc + F.octet_length(x))
