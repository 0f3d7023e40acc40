"""State and output of ``foreachBatch`` jobs, written per batch id.

Batch n reads the state that batch n-1 left and overwrites its own folders, so a batch that is replayed
after a failure starts from the same state, hands out the same ids and replaces its own partial output.
Only the last batch can be replayed, so two alternating folders hold a state; output keeps every batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class BatchStore:
    """Folders below ``root``, which all executors share."""

    root: str

    def path(self, name: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{name}" + ("" if batch_id is None else f"/batch={batch_id}")

    def write(self, name: str, batch_id: int, df: DataFrame) -> None:
        """Output of a batch."""
        df.write.mode("overwrite").parquet(self.path(name, batch_id))

    def _slot(self, name: str, batch_id: int) -> str:
        return f"{self.root}/state/{name}/slot={batch_id % 2}"

    def keep(self, name: str, batch_id: int, df: DataFrame) -> None:
        """State after a batch."""
        df.write.mode("overwrite").parquet(self._slot(name, batch_id))

    def between(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        """An intermediate result of a batch, written once and read back; its folder is used again two batches on."""
        self.keep(name, batch_id, df)
        return df.sparkSession.read.schema(df.schema).parquet(self._slot(name, batch_id))

    def previous(self, spark: SparkSession, name: str, batch_id: int, schema: StructType) -> DataFrame:
        """State after the batch before this one; empty for the first batch."""
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._slot(name, batch_id - 1))

    def keep_row(self, spark: SparkSession, name: str, batch_id: int, row: dict) -> None:
        """State of a single row, e.g. a counter."""
        self.keep(name, batch_id, spark.createDataFrame([Row(**row)]).coalesce(1))

    def previous_row(self, spark: SparkSession, name: str, batch_id: int, first: dict) -> Row:
        if batch_id == 0:
            return Row(**first)
        return spark.read.parquet(self._slot(name, batch_id - 1)).first()

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """All batches' output, with ``batch``."""
        return spark.read.option("basePath", self.path(name)).parquet(f"{self.path(name)}/batch=*")
