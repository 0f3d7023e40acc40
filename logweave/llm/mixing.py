"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be taken target / source size times. These expectations are
summed up along the source's documents in order of their size, one random offset is added, and a
document is taken once for each whole number that the sum passes at it. Because neighbours in that order are of like size, the
words taken stay near the target whatever the sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.llm.rows import picked_rows
from logweave.llm.scratch import stored

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCKS = 4096
PRIME = 2147483647


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Add the weight and the target of each source to one row per source (source_key, source_size).

    Sources in order of their key weigh ``weights``, again and again, and share the sum of all sizes by
    weight; a target stops at ``most`` times its source's size, and the excess goes to the others by weight. In order
    of size per weight, the sources that stop come first, so the share per unit of weight is the
    largest of what is left over the weights left, over all places where the stopping may end.
    """
    turn = (F.row_number().over(W.orderBy("source_key")) - 1) % len(weights) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    cap = F.col("source_size") * most
    order = W.orderBy(cap / F.col("weight"), "source_key")
    total = F.sum("source_size").over(W.partitionBy())
    stopped = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    share = weighed.withColumn("share", (total - stopped) / open_weight)
    share = share.withColumn("share", F.max("share").over(W.partitionBy()))
    return share.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("share"))).drop("share")


def random_offset(key: Column, seed: int) -> Column:
    """A number between 0 and 1 for each source, from the seed alone."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each row of ``docs``: doc_id, size, source_size, target, copies, taken, text_hash.

    A null text has size 0; a null source is a source of its own, after all others. A source without words has
    target 0 and none of its rows is taken. Ties in size go by blocks of ids, then id, then the text's hash; equal rows share
    one place after the other. An empty table gives no rows. Other columns are not read. Reruns agree.
    """
    number = F.coalesce(F.col("doc_id"), F.lit(0)) % PRIME
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("source_key"),  # null last
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
        ).withColumn("block", F.pmod(number * 48271, F.lit(PRIME)) % BLOCKS),
        "sizes",
    )
    place = ["source_key", "size", "block"]
    by_place = rows.groupBy(*place).agg(F.count("*").alias("n"))
    by_size = by_place.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    smaller = W.partitionBy("source_key").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    before_size = by_size.select("source_key", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before_size"))
    ahead = W.partitionBy("source_key", "size").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = by_place.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(before_size, ["source_key", "size"])
    before = before.select(*place, (F.col("before") + F.col("before_size")).alias("before"))

    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most).select("source_key", "source_size", "target", random_offset(F.col("source_key"), seed).alias("offset"))

    inside = F.row_number().over(W.partitionBy(*place).orderBy("doc_id", "text_hash"))
    ranked = rows.withColumn("inside", inside).join(before, place).withColumn("rank", F.col("before") + F.col("inside"))
    rate = F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))
    passed = F.floor(rate * F.col("rank") + F.col("offset")) - F.floor(rate * (F.col("rank") - 1) + F.col("offset"))
    mixed = ranked.join(targets, "source_key").withColumn("copies", passed)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` takes it, all columns."""
    return picked_rows(docs, mix_sources(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (((doc_id % {PRIME}) * 48271 % {PRIME}) + {PRIME}) % {PRIME} % {BLOCKS} AS block
  FROM documents
), s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY k
), c AS (
  SELECT k, source_size, w,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(w) OVER (ORDER BY 3 * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM s
), t AS (
  SELECT k, source_size, least(CAST(3 * source_size AS DOUBLE), w * max(share) OVER ()) AS target,
         (CAST(CAST('0x' || substr(md5('20:' || k), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u
  FROM c
), r AS (
  SELECT doc_id, k, size, row_number() OVER (PARTITION BY k ORDER BY size, block, doc_id) AS i FROM d
)
SELECT doc_id, size, source_size, target,
       CAST((floor(coalesce(target / nullif(source_size, 0), 0) * i + u) - floor(coalesce(target / nullif(source_size, 0), 0) * (i - 1) + u)) * size AS BIGINT) AS taken
FROM r JOIN t USING (k)
"""
