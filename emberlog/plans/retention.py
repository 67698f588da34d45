"""Retention: expired days are dropped as whole partitions, without reading a row."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.fixed_values import DEFAULT_RETENTION_DAYS, ERROR_RETENTION, RETENTION_SETTING
from emberlog.plans.storage import table_files
from emberlog.session import prepare
from emberlog.sources.files import delete
from emberlog.sources.manifest import publish
from emberlog.sources.skipping import skip_path
from emberlog.sources.tables import EVENT_DAY, INGEST_DAY, covered_bounds, stored_days


@dataclass(frozen=True)
class RetentionResult:
    retention_days: int
    dropped: list[date]


def retention_setting(override: int | None = None) -> int:
    """Explicit override as it is, else the setting, else the default; a setting must be a positive integer."""
    if override is not None:
        return override
    raw = os.environ.get(RETENTION_SETTING)
    if raw is None:
        return DEFAULT_RETENTION_DAYS
    try:
        days = float(raw.strip())
    except ValueError:
        days = 0.0
    if not days.is_integer() or days <= 0:
        raise ValueError(f"{ERROR_RETENTION}: '{raw}'")
    return int(days)


def list_log_days(spark: SparkSession, path: str) -> DataFrame:
    """``(event_date, files, bytes)`` per stored day. Folders that do not name a day are ignored."""
    return (
        table_files(prepare(spark), path)
        .groupBy("event_date")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def cutoff_date(retention_days: int, today: date | None = None) -> date:
    return (today or datetime.now(timezone.utc).date()) - timedelta(days=retention_days)


def expired_days(days: DataFrame, retention_days: int, today: date | None = None) -> DataFrame:
    """Days strictly before today minus N; the day exactly N days ago stays."""
    return days.where(F.col("event_date") < F.lit(cutoff_date(retention_days, today)))


def run_retention(
    spark: SparkSession,
    path: str,
    retention_days: int | None = None,
    today: date | None = None,
    *,
    rollup_path: str | None = None,
    include_rollup: bool = False,
) -> RetentionResult:
    """Drop every expired day of the log table, and with ``include_rollup`` those of the rollup too.

    By default the one-minute counts outlive the rows they were made from.
    """
    number = retention_setting(retention_days)
    dropped = _drop_days(spark, path, number, today)
    if include_rollup:
        if rollup_path is None:
            raise ValueError("include_rollup needs rollup_path")
        _drop_days(spark, rollup_path, number, today)
    return RetentionResult(number, dropped)


def expire_ingested(
    spark: SparkSession, path: str, retention_days: int | None = None, today: date | None = None
) -> RetentionResult:
    """Drop the days on which rejections or summaries were received that are older than the retention period."""
    number = retention_setting(retention_days)
    return RetentionResult(number, _drop_days(spark, path, number, today, INGEST_DAY))


def _drop_days(
    spark: SparkSession, path: str, retention_days: int, today: date | None, column: str = EVENT_DAY
) -> list[date]:
    """By the names of the folders: one listing and one call per expired day, no job."""
    cutoff, base = cutoff_date(retention_days, today), path.rstrip("/")
    days = [day for day in stored_days(spark, path, column) if day < cutoff]
    for day in days:
        for folder in (base, skip_path(base)):
            delete(spark, f"{folder}/{column}={day.isoformat()}")
    names = {day.isoformat() for day in days}
    if names & covered_bounds(spark, path).keys():
        publish(spark, path, lambda now, at: replace(now, covered={d: ends for d, ends in now.covered.items() if d not in names}))
    return days


def run_table_retention(
    spark: SparkSession, table: str, retention_days: int | None = None, today: date | None = None
) -> RetentionResult:
    """The same for a catalogue table partitioned by ``event_date`` first."""
    number = retention_setting(retention_days)
    listed = spark.sql(f"SHOW PARTITIONS {table}").select(
        F.regexp_extract("partition", r"^event_date=(\d{4}-\d{2}-\d{2})(/|$)", 1).try_cast("date").alias("event_date")
    )
    days = expired_days(listed.where("event_date IS NOT NULL").distinct(), number, today)
    dropped = [row.event_date for row in days.orderBy("event_date").collect()]
    for day in dropped:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (event_date = DATE'{day.isoformat()}')")
    return RetentionResult(number, dropped)
