"""Time-bucketed counts from raw logs or from the one-minute rollup."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.fixed_values import BUCKETS, GROUP_COLUMNS
from emberlog.functions.timestamps import bucket_start, event_date, instant_literal, iso_millis
from emberlog.operators.filters import Filters, check_filters, predicates


def check_aggregate(since, until, bucket: str, group_by: str | None, **filters) -> Filters:
    """Guard clauses: the range and the bucket size are mandatory, both enums closed."""
    for name, value in (("since", since), ("until", until)):
        if value is None:
            raise ValueError(f"{name} is required and must be a valid ISO 8601 timestamp")
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {', '.join(BUCKETS)}")
    if group_by is not None and group_by not in GROUP_COLUMNS:
        raise ValueError(f"group_by must be one of {', '.join(GROUP_COLUMNS)}")
    return check_filters(since=since, until=until, **filters)


def group_column(group_by: str | None) -> Column:
    """The grouping value, NULL when the count is not grouped."""
    return F.lit(None).cast("string") if group_by is None else F.col(group_by)


def count_by(df: DataFrame, group_by: str | None, value: Column) -> DataFrame:
    """Sum ``value`` per bucket (and group), in bucket order.

    Partial sums run before the shuffle, so a service holding a third of the rows still sends one row per bucket
    and task.
    """
    keys = ["bucket_start"] if group_by is None else ["bucket_start", "group_value"]
    totals = df.groupBy(*keys).agg(value.cast("long").alias("count"))
    out = totals if group_by is not None else totals.withColumn("group_value", group_column(None))
    return out.select("bucket_start", "group_value", "count").orderBy(*keys)


def aggregate_logs(
    df: DataFrame,
    since: str | datetime,
    until: str | datetime,
    bucket: str,
    *,
    group_by: str | None = None,
    service: str | None = None,
    level: str | None = None,
    q: str | None = None,
    attrs: Mapping[str, object] | None = None,
) -> DataFrame:
    """``(bucket_start, group_value, count)`` of the rows in ``[since, until)`` that pass every filter.

    Buckets are aligned to the epoch, not to ``since``; the range clips rows, so edge buckets may be partial, and
    a bucket without rows does not appear.
    """
    checked = check_aggregate(since, until, bucket, group_by, service=service, level=level, q=q, attrs=attrs)
    matching = df.where(reduce(and_, predicates(df, checked)))
    bucketed = matching.select(
        bucket_start(F.col("timestamp"), bucket).alias("bucket_start"), group_column(group_by).alias("group_value")
    )
    return count_by(bucketed, group_by, F.count("*"))


def rollup_batch(df: DataFrame) -> DataFrame:
    """Rows per minute, service and level. The minute is that of the parsed instant, whatever zone it was written
    in."""
    return (
        df.select(bucket_start(F.col("timestamp"), "1m").alias("bucket_start"), "service", "level")
        .groupBy("bucket_start", "service", "level")
        .agg(F.count("*").alias("count"))
    )


def merge_rollup(rollup: DataFrame) -> DataFrame:
    """Additive deltas folded to one row per key."""
    return rollup.groupBy("bucket_start", "service", "level").agg(F.sum("count").cast("long").alias("count"))


def rollup_predicates(rollup: DataFrame, since: datetime, until: datetime, filters: Filters) -> list[Column]:
    lower, upper = instant_literal(since), instant_literal(until)
    out = [F.col("bucket_start") >= lower, F.col("bucket_start") < upper]
    if "event_date" in rollup.columns:
        out += [F.col("event_date") >= event_date(lower), F.col("event_date") <= event_date(upper)]
    if filters.service is not None:
        out.append(F.col("service") == filters.service)
    if filters.level is not None:
        out.append(F.col("level") == filters.level)
    return out


def aggregate_rollup(
    rollup: DataFrame,
    since: str | datetime,
    until: str | datetime,
    *,
    group_by: str | None = None,
    service: str | None = None,
    level: str | None = None,
) -> DataFrame:
    """One-minute counts from the rollup: minutes starting in ``[since, until)``, whole minutes only."""
    checked = check_aggregate(since, until, "1m", group_by, service=service, level=level)
    matching = rollup.where(reduce(and_, rollup_predicates(rollup, checked.since, checked.until, checked)))
    keyed = matching.select("bucket_start", group_column(group_by).alias("group_value"), "count")
    return count_by(keyed, group_by, F.sum("count"))


def format_buckets(df: DataFrame) -> DataFrame:
    """Output shape: ``start`` as ISO text, ``group`` or null, ``count`` as a number."""
    return df.select(
        iso_millis(F.col("bucket_start")).alias("start"), F.col("group_value").alias("group"), F.col("count")
    )


def count_logs(df: DataFrame) -> DataFrame:
    """Rows in the table, as a one-row DataFrame."""
    return df.agg(F.count("*").alias("count"))
