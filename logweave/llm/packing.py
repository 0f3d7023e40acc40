"""Best-fit packing of token sequences by linear grouping.

All lengths lie between 1 and the capacity, so a histogram of at most ``capacity`` numbers describes
the whole corpus, and the plan is made from it alone:

1. Large lengths are sorted and cut into groups of equal cardinality; each group counts as its largest.
2. Configurations (what one sequence holds) of these few sizes are optimised by column generation.
3. Slots of the configurations are filled with actual documents, rank after rank of their group.
4. What is left over, and all small lengths, go largest first into the sequence where they fit best.

The plan is a list of runs: documents of one length, from one rank to another, lie at known places of
consecutive sequences. Each document then needs only its rank among the documents of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.llm.scratch import stored
from logweave.llm.tokens import read_tokenizer, worker_encoder
from logweave.llm.words import text_chunks

RANKS = 1 << 50


@dataclass(frozen=True)
class Run:
    """Documents of ``length`` from rank ``low`` on: ``each`` of them, from ``offset`` on, in every sequence from ``first`` on."""

    length: int
    low: int
    each: int
    first: int
    offset: int


class _Stock:
    """Documents of some lengths, handed out by rank, largest first."""

    def __init__(self, counts: list[tuple[int, int]], used: dict[int, int]):
        self.counts, self.used = counts, used
        self.at = 0

    def take(self, n: int) -> list[tuple[int, int, int]]:
        """(length, first rank, how many) of the next n documents."""
        out = []
        while n:
            length, count = self.counts[self.at]
            free = count - self.used.get(length, 0)
            got = min(n, free)
            if got:
                out.append((length, self.used.get(length, 0), got))
                self.used[length] = self.used.get(length, 0) + got
                n -= got
            if got == free:
                self.at += 1
        return out


def linear_groups(histogram: dict[int, int], smallest: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths from ``smallest`` up, largest first, in runs of about equal cardinality; a length is never split."""
    large = sorted(((n, c) for n, c in histogram.items() if n >= smallest and c), reverse=True)
    total = sum(c for _, c in large)
    out: dict[int, list[tuple[int, int]]] = {}
    seen = 0
    for length, count in large:
        out.setdefault(min(groups - 1, (seen + count // 2) * groups // total), []).append((length, count))
        seen += count
    return list(out.values())


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits into one sequence, any number of each size (unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fit = sizes <= room
        gain = np.where(fit, value[room - np.where(fit, sizes, 0)] + worth, -1.0)
        best = int(gain.argmax())
        if gain[best] > value[room - 1] + 1e-12:
            value[room], choice[room] = gain[best], best
        else:
            value[room] = value[room - 1]
    made = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if value[room] == value[room - 1]:
            room -= 1
        else:
            made[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), made


def configurations(sizes: list[int], counts: list[int], capacity: int, steps: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, whole numbers that never ask for more than ``counts``.

    Column generation for the linear programme; its result is rounded down. ``steps`` only bounds how
    near the optimum it comes: every basis on the way is a valid set of configurations.
    """
    size, need = np.array(sizes), np.array(counts, float)
    basis = np.diag(capacity // size).astype(float)  # a column for each size alone
    amount = need / np.diag(basis)
    for _ in range(steps):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(axis=0)
        value, column = _best_configuration(size, worth, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        up = change > 1e-9
        ratio = np.where(up, amount / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * change
        amount[out] = ratio[out]
        amount = np.maximum(amount, 0)
        basis[:, out] = column
    left = np.array(counts, np.int64)
    plan = []
    for j in np.argsort(-amount, kind="stable"):
        column = np.rint(basis[:, j]).astype(np.int64)
        used = column > 0
        times = int(min(np.floor(amount[j] + 1e-6), (left[used] // column[used]).min()))
        if times > 0:
            plan.append((column, times))
            left -= times * column
    return plan


def pack_plan(histogram: dict[int, int], capacity: int, groups: int = 48) -> tuple[list[Run], int]:
    """Where documents of each length go, and the number of sequences. Cost depends on the capacity, not on the counts.

    What counts as large is tried at several places: rounding up wastes least where few sizes matter, and
    configurations gain most where several large documents share a sequence. The shortest plan is kept.
    """
    plans = [_plan(histogram, capacity, max(1, capacity * eighths // 8), groups) for eighths in (4, 3, 2, 1)]
    return min(plans, key=lambda p: p[1])


def _plan(histogram: dict[int, int], capacity: int, smallest: int, groups: int) -> tuple[list[Run], int]:
    used: dict[int, int] = {}
    runs: list[Run] = []
    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first, how many) sequences
    total = 0
    alone = [(n, c) for n, c in histogram.items() if c and n > capacity - min(histogram)]
    for length, count in alone:  # no other document fits beside these
        runs.append(Run(length, 0, 1, total, 0))
        used[length] = count
        bins[capacity - length].append((total, count))
        total += count
    rest = {n: c for n, c in histogram.items() if n not in used}
    grouped = linear_groups(rest, smallest, groups)
    if grouped:
        stock = [_Stock(g, used) for g in grouped]
        plan = configurations([g[0][0] for g in grouped], [sum(c for _, c in g) for g in grouped], capacity)
        for column, times in plan:
            slots = [stock[g].take(times) for g in np.repeat(np.arange(len(column)), column)]
            cuts = sorted({0, times} | {int(x) for slot in slots for x in np.cumsum([n for _, _, n in slot])})
            where = [[0, 0] for _ in slots]  # of each slot: which part, and how many of it are placed
            for low, high in zip(cuts, cuts[1:]):
                offset = 0
                for slot, at in zip(slots, where):
                    length, rank, n = slot[at[0]]
                    runs.append(Run(length, rank + at[1], 1, total + low, offset))
                    offset += length
                    at[1] += high - low
                    if at[1] == n:
                        at[:] = [at[0] + 1, 0]
                bins[capacity - offset].append((total + low, high - low))
            total += times
    for length in sorted(rest, reverse=True):
        rank, left = used.get(length, 0), rest[length] - used.get(length, 0)
        while left:
            room = next((r for r in range(length, capacity + 1) if bins[r]), capacity)
            each = room // length
            if bins[room]:
                first, there = bins[room].pop()
            else:
                first, there = total, -(-left // each)
                total += there
            n = min(there, max(1, left // each))  # sequences that get as many as fit
            each = min(each, left)
            runs.append(Run(length, rank, each, first, capacity - room))
            bins[room - each * length].append((first, n))
            if n < there:
                bins[room].append((first + n, there - n))
            rank += n * each
            left -= n * each
    return runs, total


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece of a document: where it starts, its length and checksum, and ``nth`` of its length in its task."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["token_ids"] * with_ids
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value, end_id)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                n = np.diff(bounds)
                pieces = -(-n // capacity)
                first = n - capacity * (pieces - 1)
                doc = np.repeat(np.arange(high - low), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                at = bounds[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                sizes, begins, counts = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(begins, counts)
                nth += seen[length]
                seen[sizes] += counts
                columns = [batch.column(0).slice(low, high - low).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(nth)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", token_ids array<int>" * with_ids)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Each row of ``docs`` is a document: its ids, then ``end_id``; a null text is empty, so it is the end id
    alone. Documents of more than ``capacity`` tokens are cut so that all pieces but the first are full.
    Rows with a null or repeated id are documents of their own. An empty table gives no rows. Other
    columns are not read.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``token_ids`` if asked.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    # At most one row for each length up to the capacity.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(pack_plan(histogram, capacity)[0], key=lambda r: (r.length, r.low)) if histogram else []
    plan = docs.sparkSession.sparkContext.broadcast(
        {
            "key": np.array([r.length * RANKS + r.low for r in runs], np.int64),
            "values": np.array([(r.low, r.each, r.first, r.offset) for r in runs], np.int64).reshape(-1, 4),
        }
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values = plan.value["key"], plan.value["values"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            low, each, first, offset = values[np.searchsorted(key, length * RANKS + rank, "right") - 1].T
            nth = rank - low
            kept = [batch.schema.get_field_index(c) for c in kept_names]
            columns = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first + nth // each), pa.array(offset + nth % each * length)], [*kept_names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept_names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["token_ids"] * with_ids
    fields = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept_names)
    return ranked.select(*kept_names, "rank").mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from :func:`pack_documents` with ids: sequence_id, input_ids, doc_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "token_ids")))  # at most capacity tokens
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.token_ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids")
    )
