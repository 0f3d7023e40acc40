"""Messages that wait for their turn, kept by ranges of their place in the order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave.files import delete, folder_names
from logweave.operators.scan import block_of

FOLDERS = 64  # a batch adds to this many at most
WIDEN = 4


@dataclass(frozen=True)
class Shelf:
    """Rows in folders of ``span`` places each, below ``root``. Every batch adds files of its own and touches no others;
    a range is read only when its turn comes, and removed when it is past. A batch that would add to more than ``FOLDERS`` ranges
    takes wider ones, so their number doesn't grow with what a batch brings."""

    root: str
    span: int

    def _root(self, factor: int) -> str:
        """Where ranges of ``factor`` spans are."""
        return self.root if factor == 1 else f"{self.root}/wide={factor}"

    def _ranges(self, spark: SparkSession) -> list[tuple[int, list[int]]]:
        """The ranges that are there: (factor, buckets)."""

        def numbers(path: str, name: str) -> list[int]:
            return sorted(int(n.split("=")[1]) for n in folder_names(spark, path) if n.startswith(f"{name}="))

        return [(factor, numbers(self._root(factor), "bucket")) for factor in [1, *numbers(self.root, "wide")]]

    def add(self, rows: DataFrame, batch_id: int, at: str = "at") -> None:
        """Add a batch's rows (a stored table) by their place ``at``; a replayed batch replaces its own files."""
        low, high = rows.agg(F.min(at), F.max(at)).first()
        factor = 1
        while low is not None and high // (self.span * factor) - low // (self.span * factor) >= FOLDERS:
            factor *= WIDEN
        placed = rows.withColumns({"bucket": block_of(F.col(at), self.span * factor), "delta": F.lit(batch_id).cast("bigint")})
        (
            placed.hint("rebalance", F.col("bucket"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "delta")
            .parquet(self._root(factor))
        )

    def between(self, spark: SparkSession, schema: StructType, first: int, last: int, at: str = "at") -> DataFrame:
        """Rows with places from ``first`` to ``last``."""
        found = spark.createDataFrame([], schema)
        for factor, buckets in self._ranges(spark) if first <= last else []:
            root, width = self._root(factor), self.span * factor
            folders = [f"{root}/bucket={b}" for b in buckets if first // width <= b <= last // width]
            if folders:
                rows = spark.read.schema(schema).option("basePath", root).parquet(*folders).select(schema.names)
                found = found.unionByName(rows.where(F.col(at).between(first, last)))
        return found

    def forget(self, spark: SparkSession, now: int) -> None:
        """Remove the ranges that are past at place ``now``."""
        for factor, buckets in self._ranges(spark):
            for bucket in buckets:
                if bucket < now // (self.span * factor):
                    delete(spark, f"{self._root(factor)}/bucket={bucket}")
