"""Near-duplicate documents by min-max hashing.

A permutation's smallest and largest value over a document's shingles both agree between two documents with a chance
equal to their Jaccard similarity. Keeping both halves the hashing for a signature of given length, and since
they hardly depend on each other, the estimate's variance is lower. Bands of the signature put candidates
into buckets; every link is confirmed on the full sets.

Documents with equal sets are one node from the start. Pairs of a bucket are not listed. One document, the centre c (the
one with the most company that its members have in any bucket), is compared with all members; whoever is linked to it is in one component. What
is left are pairs (x, y) with y not linked to c:

* They share a shingle outside c: then smaller buckets, one for each such shingle, are enough. How many shingles outside c a link
  shares at least is known, so only that many of them fewer (plus one), in hash order, need a bucket.
* All they share lies in c. A link shares at least the threshold's part of x and of y, so both lie in c to that part. And
  if x is linked to c and not smaller, shared <= |c and y| and x or y >= |x| + |y outside c|, so they are no more alike than c
  and y, hence no link. So one more bucket holds those that lie in c and are not linked or smaller.

These buckets hold those rows of a group that share changes, or are fragments of the centre. Their members are joined exactly by
:mod:`tokengroups`, in which no group is compared with itself pair by pair either. No link of a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.components import connected_components
from logweave.llm.scratch import discard, stored
from logweave.llm.shingles import PLACES, sets_of
from logweave.llm.tokengroups import set_links, token_sets
from logweave.llm.words import mix

PERMUTATIONS = 84
MISSED = 1e-5  # the chance that no band holds a pair just at the threshold
SMALL = 32  # of the documents that are left, so many are compared at once
MEMBERS = 256  # documents compared with one copy of a centre's text

_random = np.random.default_rng(85)
FACTORS = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)


def band_rows(percent: int, values: int = 2 * PERMUTATIONS) -> int:
    """Values to a band: as many as still find a pair at the threshold almost surely."""
    s = percent / 100
    fine = [r for r in range(1, 17) if (1 - s**r) ** (values // r) <= MISSED]
    return max(fine, default=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest values under all permutations, then the largest."""
    low = np.full(PERMUTATIONS, ~np.uint64(0))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        values = FACTORS[:, None] * shingles[None, at : at + 4096] + SHIFTS[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return np.concatenate([low, high])


def signatures(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set_key, bands."""
    rows = band_rows(percent)
    count = 2 * PERMUTATIONS // rows
    numbers = np.arange(count, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for shingles in sets_of(batch.column(2), width):
                sizes.append(len(shingles))
                if not len(shingles):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                values = mix(signature(shingles))
                banded = (values[: count * rows].reshape(count, rows) * PLACES[:rows]).sum(axis=1, dtype=np.uint64)
                bands.append(mix(banded + numbers).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    rows_in = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    return rows_in.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def compare(centre: np.ndarray, other: np.ndarray, percent: int) -> tuple[bool, bool, np.ndarray]:
    """How a sorted set stands to a centre: whether they are linked; whether it may link to a third set inside the centre alone;
    and the shingles outside the centre of which any other link shares one (all but ``shared`` - 1, in hash order on both sides)."""
    both = len(np.intersect1d(centre, other, assume_unique=True))
    n, m = len(centre), len(other)
    linked = 100 * both >= percent * (n + m - both)
    inside = 100 * both >= percent * m and (not linked or m < n)
    smallest = -(-percent * m // 100)  # of any set linked to the other one
    shared = max(1, -(-percent * (m + smallest) // (100 + percent)) - both)
    outside = np.setdiff1d(other, centre, assume_unique=True)
    return linked, inside, outside[: max(0, len(outside) - shared + 1)]


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of sets (centre, sid) compared: centre, sid, linked, inside, outside. A centre's text moves once for up to ``MEMBERS`` pairs."""
    pairs = stored(pairs, "pairs")
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    salted = stored(pairs.join(sizes, "centre").select("centre", "sid", F.pmod(F.xxhash64("sid"), F.col("salts")).alias("salt")), "salted")
    centres = salted.select("centre", "salt", F.col("centre").alias("sid"), F.lit(True).alias("first")).distinct()
    rows = centres.unionByName(salted.withColumn("first", F.lit(False))).join(texts.hint("merge"), "sid")
    rows = rows.select("centre", "salt", "sid", "first", "text").repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.desc("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(0, np.uint64)
        for batch in batches:
            centre, sid, linked, within, outside = [], [], [], [], []
            for c, s, first, shingles in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets_of(batch.column(4), width)):
                if first:
                    whole = shingles
                    continue
                yes, inside, beyond = compare(whole, shingles, percent)
                centre.append(c)
                sid.append(s)
                linked.append(yes)
                within.append(inside)
                outside.append(beyond.view(np.int64))
            columns = [pa.array(centre, pa.int64()), pa.array(sid, pa.int64()), pa.array(linked, pa.bool_()), pa.array(within, pa.bool_()), pa.array(outside, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["centre", "sid", "linked", "inside", "outside"])

    return stored(rows.mapInArrow(run, "centre bigint, sid bigint, linked boolean, inside boolean, outside array<bigint>"), "compared")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared >= ``percent`` * all of their different shingles of ``width`` words (A-Z lower-cased). A
    document of fewer words has one shingle, its whole sequence; one without words, or with a null text, has none and is
    linked with nothing. component_id is the smallest id that links lead to; kept marks that document. Rows of one id
    are one document with several texts. Rows without an id are linked with nothing, have a null component and are kept.
    An empty table gives no rows; other columns are not read. Shingles are compared by 64-bit hashes.
    """
    rows = stored(signatures(docs, width, percent, id_col, text_col), "signatures")
    known = rows.filter("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    same = known.join(classes, "set_key").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    # One row a set: where its shingles can be read, and a number of its own.
    sets = known.join(classes, "set_key").filter("doc_id = node").groupBy("set_key", "node")
    sets = sets.agg(F.min("text_hash").alias("text_hash"), F.min("n_shingles").alias("n"))
    bands = rows.select(F.col("doc_id").alias("node"), "text_hash", "bands").dropDuplicates(["node", "text_hash"])
    sets = sets.join(bands, ["node", "text_hash"])
    sets = stored(sets.select(F.monotonically_increasing_id().alias("sid"), "node", "text_hash", "n", "bands"), "sets")
    links = _bucket_links(sets, docs, width, percent, id_col, text_col)
    components = connected_components(same.unionByName(links))
    found = rows.join(components, rows["doc_id"] == components["node"], "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return found.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def _bucket_links(sets: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between ids that connect whatever the links inside the bands' buckets connect."""
    entries = sets.select("sid", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    entries = stored(entries.join(shared, "bucket"), "entries")
    company = entries.groupBy("sid").agg(F.sum("members").alias("company"))
    # A bucket's centre need not be in it: its members' best known company, so that a group of copies shares one centre.
    best = entries.join(company, "sid").groupBy("bucket").agg(F.max_by("sid", "company").alias("best"), F.max("company").alias("company"))
    hubs = entries.join(best, "bucket").groupBy("sid").agg(F.max_by("best", "company").alias("hub"), F.max("company").alias("company"))
    centres = entries.join(hubs, "sid").groupBy("bucket").agg(F.max_by("hub", "company").alias("centre"))
    star = entries.join(centres, "bucket").filter("sid <> centre").select("centre", "sid").distinct()
    star = stored(star, "star")
    wanted = stored(star.select("sid").union(star.select("centre")).distinct().join(sets.select("sid", "node", "text_hash"), "sid"), "wanted")
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))
    # What is wanted grows with the corpus: a shuffle at every size.
    texts = texts.join(wanted.hint("merge"), (F.col("__id") == F.col("node")) & (F.col("__hash") == F.col("text_hash"))).select("sid", "text")
    texts = stored(texts, "texts")
    if texts.count() > wanted.count():  # repeated rows
        texts = stored(texts.dropDuplicates(["sid"]), "texts")
    numbers = stored(sets.select("sid", "node").join(company, "sid"), "numbers")
    compared = _compared(star, texts, width, percent)
    found = compared.filter("linked").select("centre", "sid").distinct()
    named = found.join(numbers.select(F.col("sid").alias("centre"), F.col("node").alias("a")), "centre")
    links = stored(named.join(numbers.select("sid", F.col("node").alias("b")), "sid").select("a", "b"), "links")
    # Smaller buckets, as far as a member that is not linked to the centre meets others there.
    places = F.concat(
        F.transform("outside", lambda shingle: F.xxhash64("centre", shingle)),
        F.when(F.col("inside"), F.array(F.xxhash64("centre"))).otherwise(F.array().cast("array<bigint>")),
    )
    entries = compared.select("sid", "linked", F.explode(places).alias("bucket"))
    open_ = entries.groupBy("bucket").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.bool_and("linked").alias("settled"))
    open_ = open_.filter("low < high and not settled").select("bucket")
    entries = stored(entries.join(open_, "bucket").select("bucket", "sid").distinct().join(numbers, "sid"), "entries")
    discard(compared)
    placed = entries.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    left = stored(placed.join(buckets, "bucket").select("sid").distinct(), "left")
    rest = set_links(stored(token_sets(texts.join(left.hint("merge"), "sid"), width), "rest"), percent, SMALL)
    rest = rest.join(numbers.select(F.col("sid").alias("a"), F.col("node").alias("x")), "a").join(numbers.select(F.col("sid").alias("b"), F.col("node").alias("y")), "b")
    return stored(links.unionByName(rest.select(F.col("x").alias("a"), F.col("y").alias("b"))), "links")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, all columns."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
