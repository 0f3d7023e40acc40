"""Time helpers that do not depend on the session time zone for zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01; a zone-less timestamp is taken as UTC."""
    return F.unix_timestamp(ts)


def rfc3339(seconds: Column) -> Column:
    """Epoch seconds as UTC text, e.g. 2024-01-01T00:00:07Z."""
    utc = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(utc.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
