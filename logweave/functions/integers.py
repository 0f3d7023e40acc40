"""Integer division; dividing as doubles would round large positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, by: int) -> Column:
    """BIGINT quotient, rounded down also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by)).cast("bigint")
