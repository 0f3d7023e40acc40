"""Intermediate tables in the shared folder, so that no lost executor can lose them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logweave.session import checkpoint_root


def folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later steps start from the files."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files below a :func:`stored` table whose successor has been stored."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    root = checkpoint_root(df.sparkSession).removeprefix("file://")
    for folder_uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder_uri:
            path = jvm.org.apache.hadoop.fs.Path(folder_uri)
            path.getFileSystem(conf).delete(path, True)
