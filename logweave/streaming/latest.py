"""Latest state per key under a stream of changes: buckets of keys, each a base and the changes since."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from logweave.files import delete, exists, last_number, put_if_absent
from logweave.operators.lifecycle import DELETED, latest_rows


@dataclass(frozen=True)
class LatestTable:
    """Rows below ``root`` by ``buckets`` hash ranges of ``key``; ``order`` says which row of a key is the latest.

    A batch adds its own changes (one row a key) and merges those buckets whose turn it is into a new base: every bucket once in
    ``compact_every`` batches, so no batch rewrites the table. Readers merge a bucket's base with at most
    ``compact_every`` changes of a key. Keys that are deleted stay as marks, because a row that arrives late
    must not bring them back. What a merge replaced is removed one turn later, for readers that still use it.
    """

    root: str
    key: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64
    compact_every: int = 16

    def _mark(self, nr: int) -> str:
        return f"{self.root}/batches/{nr:012d}"

    def _merged(self, batch_id: int) -> Column:
        """Per bucket the last batch that its base holds, after that batch; below 0 for none."""
        return F.lit(batch_id) - F.pmod(F.lit(batch_id) + F.col("bucket"), F.lit(self.compact_every))

    def _rows(self, spark: SparkSession, kind: str, version: str, schema: StructType, buckets: list[int] | None) -> DataFrame:
        root = f"{self.root}/{kind}"
        folders = [root] if buckets is None else [f"{root}/bucket={b}" for b in buckets]
        found = [f for f in folders if exists(spark, f)]
        whole = StructType([*schema.fields]).add("bucket", IntegerType()).add(version, LongType())
        return spark.read.schema(whole).option("basePath", root).parquet(*found) if found else spark.createDataFrame([], whole)

    def _write(self, rows: DataFrame, kind: str) -> None:
        version = rows.columns[-1]
        (
            rows.hint("rebalance", F.col("bucket"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", version)
            .parquet(f"{self.root}/{kind}")
        )

    def _merge(self, spark: SparkSession, schema: StructType, base_of: Column, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """Latest rows, marks of deleted keys included, of the bases ``base_of`` and the changes since then."""
        base = self._rows(spark, "base", "merged", schema, buckets).where(F.col("merged") == base_of).drop("merged")
        since = self._rows(spark, "changes", "batch", schema, buckets).where((F.col("batch") > base_of) & (F.col("batch") <= batch_id))
        return latest_rows(base.unionByName(since.drop("batch")), ["bucket", *self.key], self.order)

    def apply(self, records: DataFrame, batch_id: int, deleted: Column) -> None:
        """Take in a batch. A batch that is replayed replaces its own files."""
        spark, every = records.sparkSession, self.compact_every
        named = records.withColumn(DELETED, F.coalesce(deleted, F.lit(False)))
        schema = named.schema
        changes = latest_rows(named, self.key, self.order).select(schema.names)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        self._write(changes.withColumns({"bucket": bucket, "batch": F.lit(batch_id).cast("bigint")}), "changes")
        due = [b for b in range(self.buckets) if (batch_id + b) % every == 0]
        if due:
            merged = self._merge(spark, schema, F.lit(batch_id - every), batch_id, due).select(*schema.names, "bucket")
            self._write(merged.withColumn("merged", F.lit(batch_id).cast("bigint")), "base")
        put_if_absent(spark, self._mark(batch_id + 1), records.schema.json())
        for b in due:
            delete(spark, f"{self.root}/base/bucket={b}/merged={batch_id - 2 * every}")
            for batch in range(max(batch_id - 2 * every + 1, 0), batch_id - every + 1):
                delete(spark, f"{self.root}/changes/bucket={b}/batch={batch}")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The rows after the last whole batch, deleted keys left out; ``schema`` is that of the records."""
        batch_id = last_number(spark, self._mark) - 1
        stored = StructType([*schema.fields]).add(DELETED, BooleanType())
        return self._merge(spark, stored, self._merged(batch_id), batch_id).where(~F.col(DELETED)).select(schema.names)


def upsert_stream(records: DataFrame, table: LatestTable, deleted: Column, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps ``table`` at the latest state; rows may come in any order, late or more than once."""
    return records.writeStream.foreachBatch(lambda df, batch_id: table.apply(df, batch_id, deleted)).option("checkpointLocation", checkpoint)
