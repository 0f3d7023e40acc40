"""Cross-entropy difference: how much better a target model predicts a document than a background model does.

Both are bigram models of one form over one vocabulary, counted over all documents (background) and
over those of the target; a document is scored by both without its own counts. Every word, bigram and text start has a 64-bit key and
counts of its own, so the models grow with the corpus; no task holds them whole. Documents lie in blocks of about ``BLOCK_BYTES``, and a
block counts its distinct keys first. Its keys and counts go to ranges of keys, cut so that each holds about as much as ``RANGE_BYTES`` of
text has; there they are summed over all blocks, and the totals go back to the blocks that asked. A block asks once for a key, however
often it has it: the most frequent key has one entry a block, and no range is larger for it.

A word's probability mixes its bigram's share, its own share
and a uniform one; what unseen words get is matched between the models, in proportion to their sizes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.scratch import stored
from logweave.llm.words import mix, text_chunks, word_hashes

CLASSES = 1 << 18  # least number of words that the vocabulary is taken to have; where more are seen, as many as are seen
SHARES = (0.5, 0.4, 0.1)  # of bigram, word and uniform probability
UNSEEN = 0.5  # added to every word of the background
PIECE_BYTES = 1 << 20
BLOCK_BYTES = 8 * PIECE_BYTES
RANGE_BYTES = 8 << 20
ROW_BYTES = 64  # what a row counts besides its text
LEAST_RANGES = 16
START = np.uint64(0x5DEECE66D1CE4E5B)  # odd, as bigrams are: no word


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns block, size, ids and rows (the ids with their texts, compressed), stored, so that a row's block is the same wherever it is read.

    A block has several pieces of about ``PIECE_BYTES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
            ends = before + np.cumsum(sizes)
            before = int(ends[-1]) if len(ends) else before
            # Pieces are whole parts of blocks.
            _, starts = np.unique((ends - sizes) // PIECE_BYTES, return_index=True)
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)]):
                rows = pa.RecordBatch.from_arrays([c.slice(low, high - low) for c in batch.columns], ["id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows)
                block = (TaskContext.get().partitionId() << 32) + int(ends[low] - sizes[low]) // BLOCK_BYTES
                ids = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), rows.column(0))
                piece = [pa.array([block]), pa.array([int(sizes[low:high].sum())]), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(piece, ["block", "size", "ids", "rows"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return stored(rows.mapInArrow(run, f"block bigint, size bigint, ids array<{id_type}>, rows binary"), "blocks")


def pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of each piece."""
    for piece in table["rows"]:
        yield from pa.ipc.open_stream(piece.as_buffer())


def words_and_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a chunk: key, key of the bigram that it ends, whether it starts a text; and the rows' bounds. Words' keys are even."""
    words, bounds = word_hashes(data, offsets)
    now = words & ~np.uint64(1)
    first = np.zeros(len(now), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    before = np.append(START, now[:-1])[: len(now)]
    before[first] = START
    pairs = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + now) | np.uint64(1)
    return now, pairs, first, bounds


def summed(keys: np.ndarray, counts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts (an array for each model), and where each entry's key is."""
    distinct, which = np.unique(keys, return_inverse=True)
    sums = np.stack([np.bincount(which, row, len(distinct)) for row in counts]).astype(np.int64)
    return distinct, sums, which


def block_counts(rows: pa.Table, marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block with their counts in all of its texts and in those of the ids ``marks``."""
    found = [(np.zeros(0, np.uint64), np.zeros((2, 0), np.int64))]
    for piece in pieces(rows):
        wanted = pc.is_in(piece.column(0), value_set=marks).to_numpy(zero_copy_only=False)
        for low, high, data, offsets in text_chunks(piece.column(1), PIECE_BYTES):
            now, pairs, first, bounds = words_and_pairs(data, offsets)
            inside = wanted[np.repeat(np.arange(low, high), np.diff(bounds))]
            keys = np.concatenate((now, pairs, np.full(int(first.sum()), START)))
            inside = np.concatenate((inside, inside, inside[first]))
            found.append(summed(keys, (np.ones(len(keys)), inside))[:2])
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found], axis=1))[:2]


def packed(values: np.ndarray) -> bytes:
    """Numbers with all first bytes first, then all second ones, and so on, compressed; their number goes before them."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little") * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def range_totals(table: pa.Table) -> pa.Table:
    """The totals of a range of keys for each block's entries; and, in a row without a block, words of both models and distinct words."""
    lists = [[unpacked(x.as_py(), kind) for x in table[c]] for c, kind in (("keys", np.uint64), ("background", np.uint32), ("target", np.uint32))]
    bounds = np.cumsum([0, *map(len, lists[0])])
    keys, *counts = (np.concatenate(x) for x in lists)
    del lists
    keys, sums, which = summed(keys, counts)
    words = keys & np.uint64(1) == 0
    sizes = [*(int(s) for s in sums[:, words].sum(axis=1)), int(words.sum())]
    each = [[packed(s[which[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])] for s in sums]
    n = table.num_rows
    columns = [[*table["block"].to_pylist(), None], [*table["range"].to_pylist(), None], *([*x, None] for x in each), *([None] * n + [s] for s in sizes)]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["at", "range", "background", "target", "all_words", "target_words", "types"])


def _occurrences(row: np.ndarray, value: np.ndarray, values: int) -> np.ndarray:
    """How often each value occurs in its own row."""
    _, which, count = np.unique(row * values + value, return_inverse=True, return_counts=True)
    return count[which]


def token_losses(
    totals: tuple[np.ndarray, ...], size: int, types: int, ratio: float, own: tuple[np.ndarray, ...]
) -> np.ndarray:
    """Minus the log probability of each word under one model without the document it stands in.

    ``totals`` are the model's counts of the word, the word before and the bigram, ``size`` its words, ``types`` the vocabulary's size and
    ``ratio`` the model's size to the background's; ``own`` what the document adds to the counts of the
    word, the word before, the bigram and all words.
    """
    (now, before, pair), (own_now, own_before, own_pair, own_words) = totals, own
    unseen = UNSEEN * ratio
    alone = (np.maximum(now - own_now, 0) + unseen) / (np.maximum(size - own_words, 0) + unseen * types)
    history = np.maximum(before - own_before, 0)
    pair = np.minimum(np.maximum(pair - own_pair, 0), history)
    share = np.where(history > 0, pair / np.maximum(history, 1), alone)
    return -np.log(SHARES[0] * share + SHARES[1] * alone + SHARES[2] / types)


def block_losses(rows: pa.Table, totals: pa.Table) -> Iterator[list[pa.Array]]:
    """Of each chunk of a block's rows: id, words, and means of the losses: background, target with the document in it, target without."""
    keys, _ = block_counts(rows, pa.array([], next(pieces(rows)).schema.field(0).type))
    totals = totals.sort_by("range")  # ranges are first bits of keys: one after the other they are in the order of the keys
    models = [np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_py(), np.int64) for x in totals[c])]) for c in ("background", "target")]
    if any(len(m) != len(keys) for m in models):
        raise ValueError(f"{len(keys)} keys, but totals of {[len(m) for m in models]}")
    sizes = [totals[c][0].as_py() if totals.num_rows else 0 for c in ("all_words", "target_words")]
    types = max(CLASSES, totals["types"][0].as_py() if totals.num_rows else 0)
    ratio = max(sizes[1], 1) / max(sizes[0], 1)
    start = np.searchsorted(keys, START)
    for piece in pieces(rows):
        for low, high, data, offsets in text_chunks(piece.column(1), PIECE_BYTES):
            now, pairs, first, bounds = words_and_pairs(data, offsets)
            now, pairs = np.searchsorted(keys, now), np.searchsorted(keys, pairs)
            before = np.where(first, start, np.append(0, now[:-1])[: len(now)])
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            own_now = _occurrences(row, now, len(keys))
            own_before = np.where(first, 1, np.append(1, own_now[:-1])[: len(now)])
            own = np.stack([own_now, own_before, _occurrences(row, pairs, len(keys)), n[row]])
            losses = []
            for model, part, counted in ((0, 1.0, True), (1, ratio, True), (1, ratio, False)):
                counts = tuple(models[model][x] for x in (now, before, pairs))
                each = token_losses(counts, sizes[model], types, part, tuple(own * counted))
                sums = np.concatenate(([0.0], np.cumsum(each)))
                losses.append(pa.array((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)))
            yield [piece.column(0).slice(low, high - low), pa.array(n, pa.int64()), *losses]


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, difference (low: like the target).

    ``target`` has the ids of the target's documents; they may repeat, and null ids are passed over. Losses are means per word, in
    nats. A null, empty or blank text has 0 words and losses of 0. Repeated rows count, and are scored, each.
    Without target documents both models have the uniform part alone in common, and the target's is all of it. An empty table
    gives no rows. Other columns are not read.
    """
    wanted = target.select(F.col(id_col).alias("__id")).dropna().distinct().withColumn("__target", F.lit(True))
    blocks = in_blocks(docs, id_col, text_col)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(LEAST_RANGES, -(-size // RANGE_BYTES) - 1).bit_length()
    id_type = docs.schema[id_col].dataType.simpleString()
    answer_fields = ["doc_id", "n_tokens", "background_loss", "inside", "outside"]

    def count(rows: pa.Table, marks: pa.Table) -> pa.Table:
        fields = ["range", "block", "keys", "background", "target"]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns: list[list] = [[] for _ in fields]
        if rows.num_rows:
            keys, counts = block_counts(rows, marks["mark"].combine_chunks())
            ranges, starts = np.unique((keys >> np.uint64(64 - bits)).astype(np.int32), return_index=True)
            for r, low, high in zip(ranges.tolist(), starts, [*starts[1:], len(keys)]):
                for column, x in zip(columns, (r, rows["block"][0].as_py(), packed(keys[low:high]), *(packed(c[low:high].astype(np.uint32)) for c in counts))):
                    column.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    def score(rows: pa.Table, totals: pa.Table) -> pa.Table:
        chunks = list(block_losses(rows, totals))
        types = [next(pieces(rows)).schema.field(0).type, pa.int64(), *[pa.float64()] * 3]
        return pa.table([pa.chunked_array([c[k] for c in chunks], t) for k, t in enumerate(types)], names=answer_fields)

    # Both uses of the texts by block are one shuffle.
    texts = blocks.select("block", "rows").groupBy("block")
    ids = blocks.select(F.col("block").alias("at"), F.explode("ids").alias("mark"))
    marked = ids.join(wanted.hint("merge"), F.col("mark") == F.col("__id"), "left_semi").distinct()
    asked = texts.cogroup(marked.groupBy("at")).applyInArrow(count, "range int, block bigint, keys binary, background binary, target binary")
    answers = asked.groupBy("range").applyInArrow(
        range_totals, "at bigint, range int, background binary, target binary, all_words bigint, target_words bigint, types bigint"
    )
    sizes = answers.filter("at IS NULL").agg(*[F.sum(c).alias(c) for c in ("all_words", "target_words", "types")])
    totals = answers.filter("at IS NOT NULL").select("at", "range", "background", "target").crossJoin(F.broadcast(sizes))  # one row
    fields = f"doc_id {id_type}, n_tokens bigint, background_loss double, inside double, outside double"
    scored = texts.cogroup(totals.groupBy("at")).applyInArrow(score, fields)
    # Both target losses are known: with the document among those counted, and without.
    loss = F.when(F.col("__target"), F.col("inside")).otherwise(F.col("outside"))
    scored = scored.join(wanted.hint("merge"), F.col("doc_id") == F.col("__id"), "left").withColumn("target_loss", loss)
    difference = (F.col("target_loss") - F.col("background_loss")).alias("difference")
    return scored.select("doc_id", "n_tokens", "target_loss", "background_loss", difference)
