"""Target-distribution importance resampling with hashed n-gram features.

A document's features are its runs of consecutive words, hashed into buckets by CRC-32. How much more
frequent a bucket is in the target than in the corpus is its gain; a document's weight is the sum of its
features' gains, and with a Gumbel number of its own added, the highest scores are a draw without replacement
in proportion to the exponential of the weights.

CRCs are taken over whole Arrow batches. The distinct features of a batch are grouped by length into matrices of bytes, one row
a feature, and all CRCs of a matrix advance together, column by column; the buckets are then scattered back to
the features' places. Texts are read once: buckets are kept as packed numbers, about two bytes a feature.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.llm.rows import picked_rows
from logweave.llm.scratch import stored
from logweave.llm.words import ragged, segment_hashes, text_chunks, word_bounds

WIDEST = 256  # columns of a matrix; longer features, few in any text, are done one by one
SCALE = 1000  # of gains and scores, which are whole numbers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = False
BETWEEN[128:] = False


def crc_table() -> np.ndarray:
    """The CRC-32 of each byte alone, without the final complement."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


TABLE = crc_table()


def segment_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each segment of ``data``; equal segments are computed once."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    _, first, place = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
    begins, lengths = starts[first], (ends - starts)[first]
    crcs = np.zeros(len(first), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for bucket in np.split(order, cuts):
        length = int(lengths[bucket[0]])
        if length > WIDEST:
            for k in bucket:
                crcs[k] = zlib.crc32(data[begins[k] : begins[k] + length])
            continue
        matrix = data[begins[bucket][:, None] + np.arange(length)]
        crc = np.full(len(bucket), 0xFFFFFFFF, np.uint32)
        for column in range(length):
            crc = TABLE[(crc ^ matrix[:, column]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        crcs[bucket] = ~crc
    return crcs[place]


def text_buckets(texts: pa.Array, run: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per text, how many words it has, and the buckets of all its runs of 1 to ``run`` words, joined by one space, as often as they occur."""
    for _, _, data, offsets in text_chunks(texts):
        starts, ends = word_bounds(data, offsets, BETWEEN)
        bounds = np.searchsorted(starts, offsets)
        lengths = ends - starts
        # All words one after the other, each with one space behind it.
        joined = LOWER[np.append(data, np.uint8(32))[ragged(starts, lengths + 1)]] if len(starts) else np.zeros(0, np.uint8)
        stops = np.cumsum(lengths + 1) - 1
        joined[stops] = 32
        begins = stops - lengths
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found, rows = [], []
        for k in range(min(run, len(starts))):
            inside = np.flatnonzero(row[: len(row) - k] == row[k:])
            found.append(segment_crcs(joined, begins[inside], stops[inside + k]) % np.uint32(buckets))
            rows.append(row[inside])
        found = np.concatenate(found) if found else np.zeros(0, np.uint32)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        if run > 1:
            order = np.argsort(rows, kind="stable")
            found, rows = found[order], rows[order]
        yield from zip(np.diff(bounds).tolist(), np.split(found, np.searchsorted(rows, np.arange(1, len(bounds) - 1))))


def _features(docs: DataFrame, run: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_hash, n_words, n_features, and its features' buckets as packed unsigned numbers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, packed = [], []
            for n, found in text_buckets(batch.column(2), run, buckets):
                words.append(n)
                packed.append(found.astype(kind))
            columns = [pa.array(words, pa.int64()), pa.array([len(b) for b in packed], pa.int64()), pa.array([b.tobytes() for b in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    return rows.mapInArrow(each, "doc_id bigint, text_hash bigint, n_words bigint, n_features bigint, buckets binary")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All packed numbers of a batch, and where each row's end."""
    lengths = np.array([len(b.as_buffer()) if b.is_valid else 0 for b in column], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.cumsum(lengths)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket; the driver gets one number a bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(_flat(batch.column(0), kind)[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    summed = features.select("buckets").mapInArrow(each, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    if summed.num_rows:
        counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A whole number for each bucket: the scaled logarithm of its share of the target over that of the corpus, one added to each count."""
    k = len(corpus)
    top, bottom = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * top / ((s + 1.0) * bottom))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = _flat(batch.column(4), kind)
            sums = np.concatenate(([0], np.cumsum(gains[found])))[np.concatenate(([0], ends))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(sums))], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    return features.mapInArrow(each, "doc_id bigint, text_hash bigint, n_words bigint, n_features bigint, weight bigint")


def importance_scores(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    run: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank, text_hash.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn, those of the highest
    scores; rank counts them from 1 and is null elsewhere. Ties go to smaller ids; rows without an id come
    after all ids and share one random number; of repeated rows each is one row. A null or empty text has no
    features and weight 0. Very long texts are read whole. Empty tables give no rows; an empty target makes all documents nearly alike. Other columns are not read.
    """
    features = stored(_features(docs, run, buckets, id_col, text_col), "features")
    goal = _features(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")), run, buckets, "doc_id", "text")
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(goal, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    gumbel = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = _weighed(features, gains).withColumn("score", F.col("weight") + gumbel)
    scored = scored.withColumn("able", F.col("n_words") >= least_words)
    ordered = scored.orderBy(F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "text_hash")
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "placed")
    # The place has the sorted partition above bit 33 and the row in it below: partitions' counts are enough to number all rows.
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("n_able"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), (F.sum("n_able").over(W.partitionBy()) * percent / 100).alias("drawn"))
    numbered = placed.join(parts, part == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
    rank = F.when(F.col("able") & (F.col("rank") <= F.floor("drawn")), F.col("rank"))
    return numbered.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "text_hash")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`importance_scores` draws, all columns, in no order."""
    scores = importance_scores(docs, target, id_col=id_col, text_col=text_col, **options)
    return picked_rows(docs, scores.withColumn("copies", F.col("rank").isNotNull().cast("int")), id_col, text_col)


def _sql_buckets(table: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {table}"


ORACLE = f"""
WITH dw AS (SELECT doc_id, {_sql_buckets("documents")}),
bw AS (SELECT {_sql_buckets("benchmark")}),
distinct_words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
crcs AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295::BIGINT) % 10000 AS bucket
  FROM distinct_words
),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN crcs USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN crcs USING (word) GROUP BY bucket),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
         / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
),
w AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crcs USING (word) JOIN g USING (bucket) GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN w USING (doc_id)
),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM d WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN i <= 10 * (SELECT count(*) FROM d WHERE n_features >= 20) // 100 THEN i END AS rank
FROM d LEFT JOIN r USING (doc_id)
"""
