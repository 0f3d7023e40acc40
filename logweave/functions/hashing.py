"""Key hashing for topic partitions, vectorised over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit hash.
HASH_SEED = 0x9747B28C
HASH_MULTIPLIER = 0x5BD1E995
HASH_SHIFT = 24
FINAL_SHIFTS = (13, 15)
POSITIVE_MASK = 0x7FFFFFFF


def hash_keys(keys: pa.Array, standard_tail: bool = False) -> np.ndarray:
    """Hash a whole batch of byte strings at once: step i mixes word i of every key that has one.

    By default the 1 to 3 bytes left after the last whole word are read from the *start* of the key,
    which existing topics rely on; ``standard_tail`` reads them from where the words end.
    """
    keys = keys.cast(pa.large_binary())
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = keys.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    begin = offsets[:-1]
    length = offsets[1:] - begin
    mult = np.uint32(HASH_MULTIPLIER)
    state = np.uint32(HASH_SEED) ^ length.astype(np.uint32)
    words = length // 4

    def byte_at(rows: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        return raw[begin[rows] + shift].astype(np.uint32)

    rows = np.flatnonzero(words)
    for i in range(int(words.max(initial=0))):
        rows = rows[words[rows] > i]  # ever fewer, so one long key costs only its own steps
        word = byte_at(rows, 4 * i)
        for b in (1, 2, 3):
            word |= byte_at(rows, 4 * i + b) << np.uint32(8 * b)
        word *= mult
        word ^= word >> np.uint32(HASH_SHIFT)
        word *= mult
        state[rows] = state[rows] * mult ^ word

    tail = length % 4
    first = 4 * words if standard_tail else np.zeros_like(words)
    for b in (0, 1, 2):
        rows = np.flatnonzero(tail > b)
        state[rows] ^= byte_at(rows, first[rows] + b) << np.uint32(8 * b)
    rows = np.flatnonzero(tail > 0)
    state[rows] *= mult

    state ^= state >> np.uint32(FINAL_SHIFTS[0])
    state *= mult
    state ^= state >> np.uint32(FINAL_SHIFTS[1])
    return state


def murmur2(key: Column, standard_tail: bool = False) -> Column:
    """32-bit hash of a key's bytes as BIGINT; null stays null."""

    @F.arrow_udf("bigint")
    def hash_batch(keys: pa.Array) -> pa.Array:
        valid = keys.is_valid().to_numpy(zero_copy_only=False)
        hashed = hash_keys(keys.fill_null(b""), standard_tail).astype(np.int64)
        return pa.array(hashed, mask=~valid)

    return hash_batch(key.cast("binary"))


def key_partition(key: Column, partitions: int, standard_tail: bool = False) -> Column:
    """Topic partition of a key; a message without key goes to partition 0."""
    positive = murmur2(key, standard_tail).bitwiseAND(F.lit(POSITIVE_MASK))
    return F.coalesce(positive % F.lit(partitions), F.lit(0)).cast("int")
