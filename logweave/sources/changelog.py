"""Reading a change-log table from saved positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.small import join_small


def read_changelog(log: DataFrame, positions: DataFrame, scope: Sequence[str] = ("source_id",)) -> DataFrame:
    """Events after each source's saved (file, position); sources without one start at the beginning.

    Rotation and format events only describe the files and are left out.
    """
    saved = positions.select(*scope, F.struct("log_file", "log_pos").alias("saved"))
    here = F.struct("log_file", "log_pos")
    events = log.where(~F.col("kind").isin("ROTATE", "FORMAT"))
    return join_small(events, saved, scope).where(F.col("saved").isNull() | (here > F.col("saved"))).drop("saved")
