"""Files of the shared folder, through Spark's own Hadoop file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from logweave.session import checkpoint_root


def _path(spark: SparkSession, path: str):
    """(file system, qualified path); a path without a scheme is one of the default file system."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = raw.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(raw)


def shared_path(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, for tasks that open files themselves.

    A path of the local file system is refused on a cluster unless it lies below the checkpoint folder or the warehouse, which are
    shared: each executor would write to a disk of its own.
    """
    qualified = _path(spark, path)[1].toString()
    if qualified.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        shared = [checkpoint_root(spark), spark.conf.get("spark.sql.warehouse.dir")]
        if not any(f"{qualified}/".startswith(f"{_path(spark, root)[1].toString()}/") for root in shared):
            raise ValueError(f"{qualified} is on the disk of one machine; name a folder that all executors share")
    return qualified


def delete_matching(spark: SparkSession, pattern: str) -> None:
    """Remove the files that a glob pattern matches."""
    system, at = _path(spark, pattern)
    for status in system.globStatus(at) or []:
        system.delete(status.getPath(), True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, folder = _path(spark, path)
    system.mkdirs(folder)


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _path(spark, path)
    return system.exists(at)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``; none where it isn't there."""
    system, at = _path(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()] if system.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; nothing happens where there is none."""
    system, at = _path(spark, path)
    system.delete(at, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all; False if there is one already, which then stays as it is.

    Written under a name of its own and renamed, where a rename never replaces a file.
    """
    system, target = _path(spark, path)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    system.mkdirs(target.getParent())
    draft = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    no_replacing = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    no_replacing[0] = getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, no_replacing)
        return True
    except Py4JJavaError as error:
        if not system.exists(target):
            raise error
        system.delete(draft, False)
        return False


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's content."""
    system, at = _path(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def last_number(spark: SparkSession, path_of: Callable[[int], str]) -> int:
    """The highest n of files numbered 1, 2, ... without a gap; 0 if there is none. Looks at some log n of them and lists no folder."""
    high = 1
    while exists(spark, path_of(high)):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(spark, path_of(middle)) else (low, middle)
    return low
