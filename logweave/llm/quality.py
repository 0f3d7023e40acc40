"""Quality classifier: random-indexing word vectors, pooled per document, under a small neural network.

Random indexing gives each word a fixed sparse random vector; a word's vector is the sum of those of its
neighbours over the whole corpus. Words are hashed into a table of fixed size, once by their letters and once by
their shape (the kinds of characters in a row: ``Word.`` is a capital, small letters, a stop), so that words
never seen before still have a vector. A document is the mean and the spread of its words' vectors, with its
length and how much its words repeat. A two-layer network in numpy is trained on a bounded sample of labelled
documents, and its probabilities are calibrated by a temperature on rows kept out of the training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.rows import one_text_per_id
from logweave.llm.words import BYTE_VALUES, LOWER_VALUES, segment_hashes, text_chunks, word_bounds

BUCKETS = 1 << 15
SIZE = 64
NONZERO = 4
WINDOW = 2
TRAINING_ROWS = 20_000  # the most labelled documents that the network is trained on
CHUNK = 1 << 18  # so that arrays of a word's vectors stay in the cache

_shape_class = np.arange(256, dtype=np.uint8)  # each sign is its own class
_shape_class[48:58] = 48
_shape_class[65:91] = 65
_shape_class[97:123] = 97
_shape_class[128:] = 97


def index_vectors() -> np.ndarray:
    """The fixed random vectors, one a bucket, and a last one of zeros."""
    random = np.random.default_rng(31)
    vectors = np.zeros((BUCKETS + 1, SIZE), np.int8)
    for _ in range(NONZERO):
        vectors[np.arange(BUCKETS), random.integers(0, SIZE, BUCKETS)] = random.choice(np.array([-1, 1], np.int8), BUCKETS)
    return vectors


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words of a chunk by letters and by shape, and the rows' bounds in them."""
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letters = segment_hashes(data, starts, ends, LOWER_VALUES)
    kinds = _shape_class[data]
    new = np.ones(len(data), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    before = np.concatenate(([0], np.cumsum(new)))
    shapes = segment_hashes(kinds[new], before[starts], before[ends], BYTE_VALUES[::-1])
    return (letters % np.uint64(BUCKETS)).astype(np.int64), (shapes % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of a corpus, all texts of it: one of unit length a bucket (zeros where no word fell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((BUCKETS, SIZE), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                letters, shapes, bounds = word_buckets(data, offsets)
                if not len(letters):
                    continue
                n = len(letters)
                place = np.arange(n) + WINDOW * (1 + np.searchsorted(bounds[1:], np.arange(n), "right"))
                own = np.zeros((n + WINDOW * (len(bounds) + 1), SIZE), np.int8)  # rows of zeros keep documents apart
                own[place] = index[letters] + index[shapes]
                moved = [own[WINDOW + step : len(own) - WINDOW + step] for step in range(-WINDOW, WINDOW + 1) if step]
                around = sum(moved[1:], moved[0])[place - WINDOW]
                for buckets in (letters, shapes):
                    order = np.argsort(buckets, kind="stable")
                    begins = np.flatnonzero(np.append(True, np.diff(buckets[order]) != 0))
                    found = buckets[order][begins]
                    sums[found] += np.add.reduceat(around[order], begins, axis=0, dtype=np.int64)
        used = np.flatnonzero(np.abs(sums).any(axis=1))
        columns = [pa.array(used)] + [pa.array(sums[used, i]) for i in range(SIZE)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"v{i}" for i in range(SIZE))])

    parts = docs.select(text_col).mapInArrow(run, "bucket bigint, " + ", ".join(f"v{i} bigint" for i in range(SIZE)))
    # One row a bucket, so what the driver gets has a fixed bound.
    summed = parts.groupBy("bucket").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(SIZE)]).toArrow()
    vectors = np.zeros((BUCKETS, SIZE))
    if summed.num_rows:
        used = summed["bucket"].to_numpy()
        vectors[used] = np.stack([summed[f"v{i}"].to_numpy() for i in range(SIZE)], axis=1)
        unit = vectors[used] / np.maximum(np.linalg.norm(vectors[used], axis=1, keepdims=True), 1e-9)
        vectors[used] = unit - unit.mean(axis=0)
    return vectors.astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row of numbers per text: mean and spread of its words' vectors, length, repetition. Without words: zeros."""
    out = np.zeros((len(texts), 2 * SIZE + 3), np.float32)
    for low, high, data, offsets in text_chunks(texts, CHUNK):
        letters, shapes, bounds = word_buckets(data, offsets)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        own, fixed = vectors[letters] + vectors[shapes], index[letters]
        sums, squares, words = np.zeros((3, len(some), SIZE), np.float32)
        for k, row in enumerate(some):  # a row's words at a time stay in the cache
            inside = own[bounds[row] : bounds[row + 1]]
            sums[k] = inside.sum(axis=0)
            squares[k] = np.einsum("ij,ij->j", inside, inside)
            words[k] = fixed[bounds[row] : bounds[row + 1]].sum(axis=0, dtype=np.int32)
        count = n[some, None].astype(np.float32)
        mean = sums / count
        spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
        repeated = (words.astype(np.float64) ** 2).sum(axis=1) / NONZERO / n[some] ** 2  # near the sum of squared word shares
        beside = _repeats(letters, bounds)[some]
        extra = np.stack([np.log1p(n[some]), np.log(repeated + 1e-4), beside], axis=1)
        out[low + some] = np.concatenate([mean, spread, extra], axis=1)
    return out


def _repeats(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of each row's words that stand there again, as a pair with the word after them. A row's last word has none after it."""
    n = np.diff(bounds)
    inside = np.ones(len(letters), bool)
    inside[bounds[1:][n > 0] - 1] = False
    row = np.repeat(np.arange(len(n)), n)[inside]
    pair = (letters * BUCKETS + np.append(letters[1:], 0))[inside]
    order = np.lexsort((pair, row))
    same = (pair[order][1:] == pair[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.bincount(row[order][1:][same], minlength=len(n)) if len(order) else np.zeros(len(n))
    return again / np.maximum(n, 1)


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the output before the logistic function."""

    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Train on four fifths of the rows, set the temperature on the rest. One class alone gives its share as a constant."""
    x = x.astype(np.float64)
    random = np.random.default_rng(seed)
    middle, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(2 * SIZE + 3), np.ones(2 * SIZE + 3))
    net = Network(middle, scale, random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if len(y) < 10 or len(np.unique(y)) < 2:
        return net
    order = random.permutation(len(y))
    kept, fit = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - middle) / scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, batch = 0, 128
    for epoch in range(epochs):
        mixed = random.permutation(fit)
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(mixed), batch):
            rows = mixed[at : at + batch]
            inner = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - inner**2)
            slopes = [z[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), inner.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    out, truth = net.logits(x[kept]), y[kept]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -(2 * truth - 1) * out / t)) for t in choices]
    net.temperature = float(choices[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAINING_ROWS
) -> Column:
    """A column for ``docs``: the probability, 0 to 1, that a text has label 1; null and empty texts have one too.

    The word vectors are of all texts of ``docs``. The network learns from at most ``most`` labelled documents that are not
    :func:`held_out`, chosen by a hash of their id, and sees their texts only. Null labels and ids are passed over;
    without labels of both kinds the score is the share of ones (a half without any).
    """
    index = docs.sparkSession.sparkContext.broadcast(index_vectors())
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).dropna()
    usable = usable.filter(~held_out(F.col("__id"))).dropDuplicates(["__id"])
    known = docs.select(F.col(id_col).alias("__id")).dropna().distinct()
    chosen = usable.join(known, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    rows = one_text_per_id(rows, "__id", text_col, "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1), vectors.value, index.value)
            inner = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), inner.cast(pa.list_(pa.float32())), batch.column(2)], ["id", "x", "y"])

    sample = rows.select(F.col("__id"), text_col, "__label").mapInArrow(run, "id bigint, x array<float>, y int").toArrow()
    order = np.argsort(sample["id"].to_numpy(), kind="stable")
    x = pc.list_flatten(sample["x"]).to_numpy().reshape(len(order), 2 * SIZE + 3)[order]  # as Python numbers they would take ten times as much
    trained = train_network(x, sample["y"].to_numpy()[order].astype(float))
    net = docs.sparkSession.sparkContext.broadcast(tuple(getattr(trained, f.name) for f in fields(trained)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Network(*net.value).probabilities(pooled(texts, vectors.value, index.value).astype(np.float64)))

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on). Other columns are not read."""
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), quality_score(docs, labels, id_col, text_col).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns."""
    return docs.filter(quality_score(docs, labels, id_col, text_col) >= threshold)
