"""Column expressions used inside the operators."""

from logweave.functions.cyclic import (
    CYCLE,
    MAX_SEQID,
    MIN_SEQID,
    cyclic_distance,
    next_seqid,
    seqid_at,
)
from logweave.functions.envelope import (
    decode_envelope,
    decode_pack,
    encode_envelope,
    encode_pack,
    total_bytes,
)
from logweave.functions.hashing import key_partition, murmur2
from logweave.functions.times import epoch_seconds, rfc3339

__all__ = [
    "CYCLE",
    "MAX_SEQID",
    "MIN_SEQID",
    "cyclic_distance",
    "decode_envelope",
    "decode_pack",
    "encode_envelope",
    "encode_pack",
    "epoch_seconds",
    "key_partition",
    "murmur2",
    "next_seqid",
    "rfc3339",
    "seqid_at",
    "total_bytes",
]
