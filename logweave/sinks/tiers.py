"""Log files as parts of a table that age: written fast, compressed after a while, dropped at last."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.files import delete, last_number, put_if_absent, read_text
from logweave.operators.lifecycle import COMPRESS_AFTER_DAYS, EXPIRE_AFTER_DAYS, tier_by_age

CODECS = {"hot": "snappy", "compressed": "gzip"}


@dataclass(frozen=True)
class AgedTable:
    """Parts of a table by the values of column ``part`` (log files, days), below ``root``.

    Versions 1, 2, ... list every part's tier, time and folders. A new version is put whole, where there is none of its number, so
    readers see a part before or after its ageing and never both. Only parts that cross an age are read and written; all others
    keep their files. A version's list goes through the driver: a line for each part that has not expired.
    """

    root: str
    part: str

    def _path(self, nr: int) -> str:
        return f"{self.root}/versions/{nr:012d}.json"

    def _latest(self, spark: SparkSession) -> tuple[int, dict]:
        nr = last_number(spark, self._path)
        return nr, json.loads(read_text(spark, self._path(nr))) if nr else {"parts": {}, "gone": []}

    def _put(self, spark: SparkSession, nr: int, parts: dict, gone: list[str]) -> None:
        if not put_if_absent(spark, self._path(nr), json.dumps({"parts": parts, "gone": gone})):
            raise RuntimeError(f"{self.root} was changed by another job meanwhile")

    def _write(self, rows: DataFrame, tier: str) -> str:
        folder = f"rows/{uuid.uuid4().hex}"
        rows.write.option("compression", CODECS[tier]).partitionBy(self.part).parquet(f"{self.root}/{folder}")
        return folder

    def _read(self, spark: SparkSession, parts: dict) -> DataFrame:
        """Rows of these parts; their folders are named, not searched for."""
        if not parts:
            raise ValueError(f"{self.root} holds no part")
        paths = sorted(f"{self.root}/{folder}/{self.part}={name}" for name, facts in parts.items() for folder in facts["folders"])
        schema = next(reversed(parts.values()))["schema"]
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        return rows.withColumn(self.part, F.regexp_extract(F.col("_metadata.file_path"), f"/{self.part}=([^/]*)/", 1))

    def add(self, rows: DataFrame, modified: Column) -> None:
        """Add rows as hot parts; ``modified`` (epoch seconds) is a part's time, the highest counts. Part names must be fit for a path:
        letters, digits, dot, dash and underscore. A part that is compressed already is hot again."""
        spark = rows.sparkSession
        name = F.col(self.part)
        fit = F.when(name.rlike("^[A-Za-z0-9._-]+$"), name).otherwise(F.raise_error(F.concat(F.lit("not fit for a path: "), name)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != self.part)
        folder = self._write(rows.withColumn(self.part, fit), "hot")
        times = rows.groupBy(self.part).agg(F.max(modified).alias("modified")).collect()
        nr, version = self._latest(spark)
        parts = dict(version["parts"])
        for r in times:
            old = parts.get(r[self.part], {"folders": [], "modified": r.modified})
            parts[r[self.part]] = {"tier": "hot", "modified": max(old["modified"], r.modified), "folders": [*old["folders"], folder], "schema": schema}
        self._put(spark, nr + 1, parts, version["gone"])

    def age(self, spark: SparkSession, now: int, compress_after: int = COMPRESS_AFTER_DAYS, expire_after: int = EXPIRE_AFTER_DAYS) -> dict[str, str]:
        """Bring all parts to the tier of their age; returns those that changed. Files that a version before has left are removed."""
        nr, version = self._latest(spark)
        for path in version["gone"]:
            delete(spark, f"{self.root}/{path}")
        parts = version["parts"]
        if not parts:
            return {}
        listed = spark.createDataFrame([(name, facts["modified"]) for name, facts in parts.items()], "part string, modified bigint")
        aged = tier_by_age(listed, F.col("modified"), F.lit(now), compress_after, expire_after).collect()
        order = ["hot", "compressed", "expired"]
        changed = {r["part"]: r.tier for r in aged if order.index(r.tier) > order.index(parts[r["part"]]["tier"])}
        if not changed:
            return {}
        after = {name: facts for name, facts in parts.items() if name not in changed}
        older = {name: parts[name] for name, tier in changed.items() if tier == "compressed"}
        if older:
            folder = self._write(self._read(spark, older), "compressed")
            after |= {name: facts | {"tier": "compressed", "folders": [folder]} for name, facts in older.items()}
        gone = [f"{folder}/{self.part}={name}" for name in changed for folder in parts[name]["folders"]]
        self._put(spark, nr + 1, after, gone)
        return changed

    def tiers(self, spark: SparkSession) -> dict[str, str]:
        return {name: facts["tier"] for name, facts in self._latest(spark)[1]["parts"].items()}

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows that have not expired."""
        return self._read(spark, self._latest(spark)[1]["parts"])
