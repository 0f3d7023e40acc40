"""Shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from logweave.llm.words import mix, text_chunks, word_hashes

PLACES = np.random.default_rng(86).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per row, the sorted different hashes of its shingles of ``width`` words; of fewer words, the whole sequence."""
    turned = [words * PLACES[k] + PLACES[k + 32] for k in range(width)]
    inner = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        inner += mix(turned[k])[k : k + len(inner)]
    inner = mix(inner)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= width:
            yield np.unique(inner[low : high - width + 1])
        elif high > low:
            short = np.uint64(high - low) + sum((mix(turned[k])[low + k : low + k + 1] for k in range(high - low)), np.zeros(1, np.uint64))
            yield mix(short)
        else:
            yield np.zeros(0, np.uint64)


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(texts):
        words, bounds = word_hashes(data, offsets, lower=True)
        yield from shingle_sets(words, bounds, width)
