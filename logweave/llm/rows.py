"""Bring decisions made on narrow tables back to whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.scratch import stored


def one_text_per_id(rows: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Of the rows of an id the text with the smallest hash, folded before rows are shuffled; ``others`` are the same for all rows of an id."""
    return rows.groupBy(id_col, *others).agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col))


def picked_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` as often as ``decided`` says, all columns.

    ``decided`` has doc_id, text_hash (``xxhash64`` of the text) and ``copies`` for each row. Rows equal in id and text
    are taken together: one of them as often as all of them would be.
    """
    sums = decided.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n"))
    sums = stored(sums.filter("__copies > 0").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), "picked")
    text_hash = F.xxhash64(text_col)

    def joined(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[id_col].eqNullSafe(some["__id"]) & (text_hash == some["__hash"]))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies")).alias("__nth")).drop("__nth")

    out = repeated(joined(sums.filter("__n = 1")))
    several = sums.filter("__n > 1")
    if several.isEmpty():
        return out
    return out.unionByName(repeated(joined(several).dropDuplicates(["__id", "__hash"])))
