"""Newest-first log search and its output shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.fixed_values import DEFAULT_LIMIT
from emberlog.functions.timestamps import iso_millis
from emberlog.operators.filters import apply_filters, check_limit
from emberlog.schema import LOG_COLUMNS


def newest_first(df: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` newest rows; ties on the instant go to the larger id. Planned as a per-partition top-k."""
    return df.select(*LOG_COLUMNS).orderBy(F.desc("timestamp"), F.desc("id")).limit(rows)


def search_logs(df: DataFrame, *, limit: int = DEFAULT_LIMIT, cursor: str | None = None, **filters) -> DataFrame:
    """At most ``limit`` rows matching every filter, newest first, older than ``cursor`` if one is given."""
    return newest_first(apply_filters(df, cursor=cursor, **filters), check_limit(limit))


def format_logs(df: DataFrame) -> DataFrame:
    """Output shape: id as text, timestamp as ISO text cut to milliseconds, attributes as typed JSON."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        iso_millis(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        "attributes",
    )
