"""Scans of the stored tables.

Logs and rollup are Parquet, partitioned by ``event_date`` and ``batch_id``. A compacted day keeps its rows in segments,
partitions with a negative batch number; the table's manifest says up to which batch they stand in for the originals. All
conditions are on partition columns, so files that were replaced are never opened, and no job is needed to know them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.schema import LOG_TABLE_SCHEMA, REJECTED_TABLE_SCHEMA, ROLLUP_TABLE_SCHEMA, SUMMARY_TABLE_SCHEMA
from emberlog.session import prepare
from emberlog.sources.commits import COMMITS, committed_batch  # noqa: F401  (named here by their users)
from emberlog.sources.files import child_names
from emberlog.sources.manifest import read_manifest

_DAY_FOLDER = re.compile(r"(\w+)=(\d{4}-\d{2}-\d{2})")
#: The day column of logs and rollup, and that of rejections and summaries.
EVENT_DAY, INGEST_DAY = "event_date", "ingest_date"


def compacted_batch(upto: int) -> int:
    """Partition number of the segment whose last batch is ``upto``."""
    return -(upto + 1)


def covered_bounds(spark: SparkSession, path: str) -> dict[str, int]:
    """Up to which batch each compacted day (ISO text) is covered; at most one entry per day of the table."""
    return {day: ends[-1] for day, ends in read_manifest(spark, path).covered.items()}


def stored_days(spark: SparkSession, path: str, day: str = EVENT_DAY) -> list[date]:
    """The days that have a folder, from one listing and without a job. Other folders are ignored."""
    days = []
    for name in child_names(spark, path):
        if (found := _DAY_FOLDER.fullmatch(name)) and found[1] == day:
            try:
                days.append(date.fromisoformat(found[2]))
            except ValueError:
                continue
    return sorted(days)


def day_folders(spark: SparkSession, path: str, days: list[date] | None, day: str = EVENT_DAY) -> list[str]:
    """Folders to list for these days, those without one left out; the whole table if no days are named.

    One listing of the table's folder, whatever the number of days. Empty if there is nothing to read.
    """
    base = path.rstrip("/")
    there = {name for name in child_names(spark, base) if name.startswith(f"{day}=")}
    if days is None:
        return [base] if there else []
    return [f"{base}/{name}" for name in (f"{day}={wanted.isoformat()}" for wanted in days) if name in there]


def _scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    upto_batch: int | None,
    days: list[date] | None,
    generation: int | None = None,
    without_files: Sequence[str] = (),
    day: str = EVENT_DAY,
) -> DataFrame:
    # The manifest comes before the listing: what it replaces later is still there.
    manifest = read_manifest(spark, path, generation)
    if manifest is None:
        raise ValueError(f"generation {generation} of {path} is gone")
    covered = manifest.covered
    folders = day_folders(spark, path, days, day)
    if not folders:
        return prepare(spark).createDataFrame([], schema)
    df = prepare(spark).read.schema(schema).option("basePath", path).parquet(*folders)
    if without_files:
        # A condition on file paths alone is applied to the listing.
        df = df.where(~F.col("_metadata.file_path").isin(list(without_files)))
    if days is not None:
        df = df.where(F.col(day).isin(days))
    if covered:
        segments = F.from_json(F.lit(json.dumps(covered)), "map<string,array<bigint>>")
        ends = F.try_element_at(segments, F.col(day).cast("string"))
        fresh = F.col("batch_id") > F.coalesce(F.element_at(ends, -1), F.lit(-1).cast("long"))
        df = df.where(fresh | F.coalesce(F.array_contains(ends, -F.col("batch_id") - 1), F.lit(False)))
    else:
        df = df.where(F.col("batch_id") >= 0)
    if upto_batch is not None:
        df = df.where(F.col("batch_id") <= upto_batch)
    return df


def read_logs(
    spark: SparkSession,
    path: str,
    upto_batch: int | None = None,
    days: list[date] | None = None,
    generation: int | None = None,
    without_files: Sequence[str] = (),
) -> DataFrame:
    """Stored logs: the six log columns, ``attr_text`` and the partition columns.

    Filters prune partitions without help; ``days`` also saves listing the folders of all other days. ``generation``
    reads the table as that generation of its manifest had it, as long as it is kept; files listed in ``without_files``
    are left out of the scan. No job is run.
    """
    return _scan(spark, path, LOG_TABLE_SCHEMA, upto_batch, days, generation, without_files)


def read_rollup(
    spark: SparkSession, path: str, upto_batch: int | None = None, days: list[date] | None = None
) -> DataFrame:
    """Stored one-minute deltas; sum ``count`` over equal keys."""
    return _scan(spark, path, ROLLUP_TABLE_SCHEMA, upto_batch, days)


def _ingested(
    spark: SparkSession, path: str, schema: T.StructType, days: list[date] | None, upto_batch: int | None, origin: bool
) -> DataFrame:
    own = [name for name in schema.names if name not in ("file_path", "source_batch", INGEST_DAY, "batch_id")]
    old = [name for name in child_names(spark, path) if name.startswith("batch_id=")] if days is None else []
    scan = _scan(spark, path, schema, upto_batch, stored_days(spark, path, INGEST_DAY) if old else days, day=INGEST_DAY)
    rows = scan.select(*own, F.col("source_batch").alias("batch_id"), "file_path", INGEST_DAY)
    if old:
        # Batches from before these tables had days.
        plain = T.StructType([field for field in schema.fields if field.name in (*own, "batch_id")])
        before = spark.read.schema(plain).option("basePath", path).parquet(*(f"{path.rstrip('/')}/{name}" for name in old))
        if upto_batch is not None:
            before = before.where(F.col("batch_id") <= upto_batch)
        rows = rows.unionByName(before.select(*own, "batch_id"), allowMissingColumns=True)
    return rows if origin else rows.drop("file_path", INGEST_DAY)


def read_rejected(
    spark: SparkSession,
    path: str,
    days: list[date] | None = None,
    upto_batch: int | None = None,
    *,
    origin: bool = False,
) -> DataFrame:
    """Rejected entries, of these ingestion days if any are named. ``(batch_id, envelope_id, index)`` names an entry;
    ``origin`` adds the file that its envelope came in and the day."""
    return _ingested(spark, path, REJECTED_TABLE_SCHEMA, days, upto_batch, origin)


def read_summary(
    spark: SparkSession,
    path: str,
    days: list[date] | None = None,
    upto_batch: int | None = None,
    *,
    origin: bool = False,
) -> DataFrame:
    """Envelopes with their counts and status; the same parameters."""
    return _ingested(spark, path, SUMMARY_TABLE_SCHEMA, days, upto_batch, origin)
