"""Exact deduplication with the most frequent texts taken out before the shuffle.

Misra-Gries summaries find every digest that could hold a large share of the rows: a block of rows keeps the
``hot`` most frequent values of its exact counts, each less the count of the next one, and summaries are added up and cut
again. A value loses at most rows / (hot + 1) of its count, so none above that is missed. The few candidates are
counted exactly where the rows lie, with partial sums; their winners are broadcast, ``hot`` rows at most, and settle
their groups without moving a row. No group that is left is large, so an ordinary shuffle by digest does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.llm.rows import picked_rows
from logweave.llm.scratch import stored

BLOCK_PARTS = 16  # input partitions to a block


def _cut(counts: DataFrame, block: list[str], hot: int) -> DataFrame:
    """The ``hot`` largest counts n of each block, less the next one."""
    turn = F.row_number().over(W.partitionBy(*block).orderBy(F.desc("n"), "value"))
    first = counts.withColumn("turn", turn).filter(F.col("turn") <= hot + 1)
    over = F.max(F.when(F.col("turn") == hot + 1, F.col("n"))).over(W.partitionBy(*block))
    less = first.withColumn("n", F.col("n") - F.coalesce(over, F.lit(0)))
    return less.filter("n > 0").select(*block, "value", "n")


def frequent_values(df: DataFrame, value: str, part: str, hot: int) -> DataFrame:
    """At most ``hot`` values (column ``value``): all that more than one in ``hot`` + 1 rows has, and maybe others."""
    counts = df.groupBy(F.expr(f"{part} div {BLOCK_PARTS}").alias("block"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    summed = _cut(counts, ["block"], hot).groupBy("value").agg(F.sum("n").alias("n"))
    largest = summed.orderBy(F.desc("n"), "value").limit(hot + 1).withColumn("block", F.lit(0))
    return _cut(largest, ["block"], hot).select("value")


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest: size, largest id, and the row that stays (the first of those with that id)."""
    by_id = rows.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    return by_id.groupBy("text_sha256").agg(
        F.sum("n").alias("group_size"),
        F.max("doc_id").alias("keep_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when their SHA-256 digests are; null counts as the empty text. Of equal texts the row with the
    largest id stays; rows without an id lose to any id; of rows with equal text and equal id, one stays.
    An empty table gives no rows. Other columns are not read.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
            F.xxhash64(text_col).alias("text_hash"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("part"),
        ),
        "digests",
    )
    rows = rows.withColumn("short", F.xxhash64("text_sha256"))  # for the summaries; the digest decides
    candidates = F.broadcast(frequent_values(rows, "short", "part", hot))
    found = rows.join(candidates, rows["short"] == candidates["value"], "left_semi")
    counted = found.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    counted = stored(counted.filter("group_size > 1"), "frequent")  # at most `hot` rows
    first = (
        rows.join(F.broadcast(counted), "text_sha256")
        .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("text_sha256", "keep_id", "group_size")
        .agg(F.min("row").alias("keep_row"))
    )
    winners = stored(first, "winners")
    settled = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti").repartition("text_sha256")
    dealt = rest.join(_winners(rest), "text_sha256")
    out = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "text_hash"]
    return settled.select(*out).unionByName(dealt.select(*out))


def without_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, all columns."""
    groups = exact_groups(docs, id_col, text_col)
    return picked_rows(docs, groups.withColumn("copies", F.col("kept").cast("int")), id_col, text_col)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
