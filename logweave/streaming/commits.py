"""Commit log: which folders hold the rows of which batch, a manifest for each committed batch.

A batch writes its rows to a folder of its own try and then puts its manifest, which is there whole or not at
all. Readers go by manifests and never list folders, so they meet no file of a try that failed, and a batch that is replayed after
its commit changes nothing. Rows found damaged later are replaced by a repair: another folder and a manifest beside the commits,
whose latest one stands for its batch from then on; the damaged folder stays as it is, aside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from logweave.files import exists, make_folder, put_if_absent
from logweave.streaming.relay import BatchWriter
from logweave.streaming.state import BatchStore

ManifestWriter = Callable[[SparkSession, list[Row], int], None]
MANIFEST = "batch bigint, folder string, schema string, facts map<string,bigint>, repair int"


@dataclass(frozen=True)
class CommitLog:
    """Batches 0, 1, 2, ... of one writing stream, below ``root``, which all executors share."""

    root: str

    def manifest_path(self, batch_id: int) -> str:
        return f"{self.root}/commits/{batch_id:012d}.json"

    def commit(self, df: DataFrame, batch_id: int, facts: Mapping[str, int] | None = None) -> None:
        """Write the rows of a batch and make them seen at once. A batch committed before stands: a replay has the same rows."""
        spark = df.sparkSession
        if exists(spark, self.manifest_path(batch_id)):
            return
        put_if_absent(spark, self.manifest_path(batch_id), json.dumps(self._written(df, batch_id, facts)))

    def _written(self, df: DataFrame, batch_id: int, facts: Mapping[str, int] | None) -> dict:
        folder = f"rows/batch={batch_id}/try={uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return {"batch": batch_id, "folder": folder, "schema": df.schema.json(), "facts": dict(facts or {})}

    def replace(self, df: DataFrame, manifest: Row) -> None:
        """Put rows in the place of those that ``manifest`` names, with the same facts. Of several that try, one does."""
        nr = (manifest.repair or 0) + 1
        row = self._written(df, manifest.batch, manifest.facts) | {"repair": nr}
        put_if_absent(df.sparkSession, f"{self.root}/repairs/{manifest.batch:012d}-{nr:04d}.json", json.dumps(row))

    def _repairs(self, spark: SparkSession) -> dict[int, Row]:
        """The latest repair of each batch that has one."""
        if not exists(spark, f"{self.root}/repairs"):
            return {}
        found = spark.read.schema(MANIFEST).json(f"{self.root}/repairs").collect()
        return {m.batch: m for m in sorted(found, key=lambda m: m.repair)}

    def manifests(self, spark: SparkSession, first: int = 0, last: int | None = None) -> list[Row]:
        """Manifests in order of their batches, one small row each; a repair stands in the place of what it replaces."""
        names = [self.manifest_path(b) for b in range(first, last + 1)] if last is not None else [f"{self.root}/commits"]
        if not names or (last is None and not exists(spark, names[0])):
            return []
        found, repairs = spark.read.schema(MANIFEST).json(names).collect(), self._repairs(spark)
        return sorted((repairs.get(m.batch, m) for m in found if m.batch >= first), key=lambda m: m.batch)

    def rows(self, spark: SparkSession, manifests: list[Row]) -> DataFrame:
        """The rows of these batches, with ``batch``."""
        if not manifests:
            raise ValueError(f"nothing is committed below {self.root}")
        schema = StructType.fromJson(json.loads(manifests[-1].schema)).add("batch", "long")
        folders = [f"{self.root}/{m.folder}" for m in manifests]
        return spark.read.schema(schema).option("basePath", f"{self.root}/rows").parquet(*folders).select(schema.names)

    def read(self, spark: SparkSession) -> DataFrame:
        """All committed rows, with ``batch``."""
        return self.rows(spark, self.manifests(spark))

    def follow(
        self, spark: SparkSession, store: BatchStore, write: ManifestWriter, batches_per_trigger: int | None = None
    ) -> DataStreamWriter:
        """A writer that hands every committed batch's manifest to ``write``, in order of the batches, none twice and none left out.

        The stream is of manifests only; rows are read by whoever needs them. Its state is the batch that comes next, so the order in which files are found doesn't matter.
        """
        make_folder(spark, f"{self.root}/commits")
        stream = spark.readStream.schema(MANIFEST)
        if batches_per_trigger:
            stream = stream.option("maxFilesPerTrigger", batches_per_trigger)

        def batch(found: DataFrame, batch_id: int) -> None:
            session = found.sparkSession
            following = store.previous_row(session, "next", batch_id, {"batch": 0}).batch
            last = max((m.batch for m in found.select("batch").collect()), default=-1)
            if last >= following:  # its writer committed all before it
                write(session, self.manifests(session, following, last), batch_id)
                following = last + 1
            else:
                write(session, [], batch_id)
            store.keep_row(session, "next", batch_id, {"batch": following})

        manifests = stream.json(f"{self.root}/commits")
        return manifests.writeStream.foreachBatch(batch).option("checkpointLocation", store.path("checkpoint"))

    def follow_rows(self, spark: SparkSession, store: BatchStore, write: BatchWriter, batches_per_trigger: int | None = None) -> DataStreamWriter:
        """As :meth:`follow`, with the rows themselves."""

        def rows(session: SparkSession, manifests: list[Row], batch_id: int) -> None:
            if manifests:
                write(self.rows(session, manifests).drop("batch"), batch_id)

        return self.follow(spark, store, rows, batches_per_trigger)


def commit_writer(log: CommitLog) -> BatchWriter:
    return lambda df, batch_id: log.commit(df, batch_id)
