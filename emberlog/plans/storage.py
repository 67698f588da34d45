"""Sinks, table layout and compaction.

Every sink overwrites the partitions of its batch; :func:`drop_batch` removes what an earlier attempt at it left.
Compaction is tiered: new batches of a day become a segment, together with the last segments as long as these are not
much larger, so that a row is rewritten a logarithmic number of times and not at every compaction. It only moves forward:
a day covered up to a batch takes no batch up to it any more and no lower bound. What it replaces is retired, not deleted, so readers that are under way keep their files until :func:`vacuum_table`.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlog.functions.timestamps import event_date
from emberlog.operators.aggregate import merge_rollup
from emberlog.plans.skip_index import index_files
from emberlog.schema import LOG_TABLE_SCHEMA, REJECTED_TABLE_SCHEMA, ROLLUP_TABLE_SCHEMA, SUMMARY_TABLE_SCHEMA
from emberlog.sources.commits import committed_batch
from emberlog.sources.files import bytes_below, child_names, delete
from emberlog.sources.manifest import Manifest, generation_path, generations, publish, read_manifest
from emberlog.sources.skipping import skip_path
from emberlog.sources.tables import (
    EVENT_DAY,
    INGEST_DAY,
    compacted_batch,
    covered_bounds,
    day_folders,
    read_logs,
    read_rejected,
    read_rollup,
    read_summary,
    stored_days,
)

#: Compacted log files aim at this many bytes.
TARGET_FILE_BYTES = 128 << 20
#: A segment is merged with what follows it if it has at most so many times the bytes.
FANOUT = 4
#: How long replaced folders stay for readers that are under way.
GRACE_SECONDS = 3600.0

_BATCH_FOLDER = re.compile(r"batch_id=(-?\d+)")


def with_event_date(df: DataFrame) -> DataFrame:
    """Add the UTC day that a row is stored under."""
    return df.withColumn("event_date", event_date(F.col("timestamp")))


def _write(df: DataFrame, path: str, *partition_columns: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_columns)
        .parquet(path)
    )


def _stamp(df: DataFrame, batch_id: int) -> DataFrame:
    return df.withColumn("batch_id", F.lit(batch_id).cast("long"))


def _refuse_covered(spark: SparkSession, path: str, batch_id: int) -> None:
    """A batch that compaction has covered would never be seen, so it is not written."""
    bound = max(covered_bounds(spark, path).values(), default=-1)
    if 0 <= batch_id <= bound:
        raise ValueError(f"batch {batch_id} comes too late: compaction has covered all batches up to {bound}")


def drop_batch(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove every row of a batch from the four tables below ``root``."""
    base = root.rstrip("/")
    for table in ("logs", "rollup"):
        _refuse_covered(spark, f"{base}/{table}", batch_id)
    for table in ("logs", "rollup"):
        for name in child_names(spark, f"{base}/{table}"):
            if name.startswith("event_date="):
                delete(spark, f"{base}/{table}/{name}/batch_id={batch_id}")
    for table in ("rejected", "summary"):
        for name in child_names(spark, f"{base}/{table}"):
            if name.startswith("ingest_date="):
                delete(spark, f"{base}/{table}/{name}/batch_id={batch_id}")
        delete(spark, f"{base}/{table}/batch_id={batch_id}")


def append_logs(df: DataFrame, path: str, batch_id: int, *, index: bool = False) -> None:
    """Append a batch under its days.

    Rebalancing by day gives few files per day, splits a day that dominates the batch over several tasks and merges
    small ones. Rows are ordered by instant within a file for tight row-group statistics. ``index`` also writes the
    bitmaps that text and attribute searches skip files by; without it that waits for compaction.
    """
    _refuse_covered(df.sparkSession, path, batch_id)
    rows = _stamp(with_event_date(df), batch_id).select(*LOG_TABLE_SCHEMA.names)
    ordered = rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "batch_id", "timestamp", "id")
    _write(ordered, path, "event_date", "batch_id")
    if index:
        index_files(df.sparkSession, path, batch_id=batch_id)


def append_rollup(counts: DataFrame, path: str, batch_id: int) -> None:
    """Append the batch's one-minute counts as deltas: a new key is its first delta, a known key gains one."""
    _refuse_covered(counts.sparkSession, path, batch_id)
    rows = _stamp(counts, batch_id).withColumn("event_date", event_date(F.col("bucket_start")))
    ordered = (
        rows.select(*ROLLUP_TABLE_SCHEMA.names)
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "batch_id", "bucket_start")
    )
    _write(ordered, path, "event_date", "batch_id")


def _with_origin(df: DataFrame, schema: StructType, batch_id: int) -> DataFrame:
    """Add the file, the day of ingestion and the batch, from ``file_path`` and ``received_at`` where the rows have them."""
    path = F.col("file_path") if "file_path" in df.columns else F.lit(None).cast("string")
    received = F.col("received_at") if "received_at" in df.columns else F.current_timestamp()
    rows = df.withColumn("file_path", path).withColumn("ingest_date", event_date(received))
    return _stamp(rows.withColumn("source_batch", F.lit(batch_id).cast("long")), batch_id).select(*schema.names)


def append_rejected(df: DataFrame, path: str, batch_id: int) -> None:
    """Append rejected entries under the day they were received."""
    _refuse_covered(df.sparkSession, path, batch_id)
    # By key rather than round robin, which would have to sort every task's rows first.
    rows = _with_origin(df, REJECTED_TABLE_SCHEMA, batch_id).hint("rebalance", "envelope_id")
    _write(rows, path, "ingest_date", "batch_id")


def append_summary(df: DataFrame, path: str, batch_id: int) -> None:
    """Append envelope summaries under the day they were received."""
    _refuse_covered(df.sparkSession, path, batch_id)
    _write(_with_origin(df, SUMMARY_TABLE_SCHEMA, batch_id), path, "ingest_date", "batch_id")


def _batches(spark: SparkSession, path: str, day: date, column: str = EVENT_DAY) -> list[int]:
    """The numbers of a day's partition folders, from the listing."""
    names = child_names(spark, f"{path.rstrip('/')}/{column}={day.isoformat()}")
    return [int(found[1]) for found in map(_BATCH_FOLDER.fullmatch, names) if found]


def _tiers(
    spark: SparkSession, path: str, days: Iterable[date], upto: int, column: str = EVENT_DAY
) -> dict[date, tuple[list[int], list[int]]]:
    """For each of the days with batches that are not in a segment yet: the ends of the segments that stay, and of those
    that are merged with the new batches, because they are not much larger than what follows them."""
    covered, found = read_manifest(spark, path).covered, {}
    for day in days:
        kept, merged = list(covered.get(day.isoformat(), [])), []
        fresh = [n for n in _batches(spark, path, day, column) if (kept[-1] if kept else -1) < n <= upto]
        if not fresh:
            continue

        def size(batch: int, folder=f"{path.rstrip('/')}/{column}={day.isoformat()}") -> int:
            return bytes_below(spark, f"{folder}/batch_id={batch}")

        following = sum(map(size, fresh))
        while kept and (last := size(compacted_batch(kept[-1]))) <= FANOUT * following:
            merged.append(kept.pop())
            following += last
        found[day] = kept, merged
    return found


def _to_merge(tiers: dict[date, tuple[list[int], list[int]]], column: str = EVENT_DAY) -> Column:
    """The rows of the new batches and of the segments that are merged with them."""
    kept = F.from_json(F.lit(json.dumps({day.isoformat(): kept for day, (kept, _) in tiers.items()})), "map<string,array<bigint>>")
    staying = F.try_element_at(kept, F.col(column).cast("string"))
    return ~F.coalesce(F.array_contains(staying, -F.col("batch_id") - 1), F.lit(False))


def _publish(
    spark: SparkSession, path: str, tiers: dict[date, tuple[list[int], list[int]]], upto: int, column: str = EVENT_DAY
) -> None:
    """Switch new readers over, after the new segments are complete, and retire what they replace."""
    replaced = []
    for day, (kept, _) in tiers.items():
        staying = {compacted_batch(end) for end in [*kept, upto]}
        gone = (n for n in _batches(spark, path, day, column) if n <= upto and n not in staying)
        replaced += [f"{column}={day.isoformat()}/batch_id={n}" for n in gone]

    def change(now: Manifest, at: float) -> Manifest:
        for day, (kept, merged) in tiers.items():
            if now.covered.get(day.isoformat(), []) != [*kept, *reversed(merged)]:
                raise RuntimeError(f"{day} was compacted by another job meanwhile")
        segments = {day.isoformat(): [*kept, upto] for day, (kept, _) in tiers.items()}
        return replace(now, covered=now.covered | segments, retired=dict.fromkeys(replaced, at) | now.retired)

    publish(spark, path, change)


def vacuum_table(spark: SparkSession, path: str, grace_seconds: float = GRACE_SECONDS) -> int:
    """Delete the folders that were replaced longer ago than the grace period; returns how many.

    Generations of the manifest older than that go as well, so a page cursor that names one continues on the newest.
    Compaction calls it with the default. A failure half-way leaves work for the next call only.
    """
    limit = time.time() - grace_seconds
    now = read_manifest(spark, path)
    spent = [folder for folder, at in now.retired.items() if at <= limit]
    for folder in spent:
        for base in (path.rstrip("/"), skip_path(path)):
            delete(spark, f"{base}/{folder}")
    if spent:
        now = publish(spark, path, lambda m, at: replace(m, retired={f: since for f, since in m.retired.items() if f not in spent}))
    for number in generations(spark, path):
        following = read_manifest(spark, path, number + 1) if number < now.generation else None
        if number < now.generation and (following is None or following.published <= limit):
            delete(spark, generation_path(path, number))
    return len(spent)


def table_files(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame:
    """``(event_date, batch_id, path, length)``, one row per data file (of these days), from the listing alone."""
    folders = day_folders(spark, path, days)
    if not folders:
        return spark.createDataFrame([], "event_date date, batch_id long, path string, length long")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("basePath", path)
    files = reader.load(folders).select(
        F.col("event_date").cast("string").try_cast("date").alias("event_date"),
        F.col("batch_id").cast("long").alias("batch_id"),
        "path",
        "length",
    )
    return files.where(F.col("event_date").isNotNull() if days is None else F.col("event_date").isin(days))


def _refuse_uncommitted(spark: SparkSession, path: str, upto_batch: int) -> None:
    """Of an ingested table, only batches with a commit mark are final."""
    last = committed_batch(spark, path.rstrip("/").rpartition("/")[0])
    if last is not None and upto_batch > last:
        raise ValueError(f"batches up to {upto_batch} cannot be compacted: only those up to {last} are committed")


def compact_day(spark: SparkSession, path: str, day: date, upto_batch: int) -> None:
    """Merge the small files of one day, batches up to ``upto_batch``, into a segment of large ones sorted by instant.

    Only committed batches may be given. Readers keep seeing the originals until a new generation of the manifest names
    the merged partition, and those that planned before it keep their files after that too; a failure at any point
    leaves the same rows visible and the job can simply run again. A published partition is never written again: the
    bound of a day only rises, and a lower or the same one only deletes what has been out of use for long enough.
    """
    _refuse_uncommitted(spark, path, upto_batch)
    tiers = _tiers(spark, path, [day], upto_batch)
    if not tiers:
        vacuum_table(spark, path)
        return
    rows = read_logs(spark, path, upto_batch, [day]).where(_to_merge(tiers))
    base, bound = f"{path.rstrip('/')}/event_date={day.isoformat()}", (tiers[day][0] or [-1])[-1]
    merging = [n for n in _batches(spark, path, day) if bound < n <= upto_batch] + [compacted_batch(end) for end in tiers[day][1]]
    size = sum(bytes_below(spark, f"{base}/batch_id={n}") for n in merging)
    parts = max(1, -(-size // TARGET_FILE_BYTES))
    # By instant and id, so neither a hot day nor a hot instant ends up in one task.
    merged = _stamp(rows.drop("batch_id"), compacted_batch(upto_batch)).select(*LOG_TABLE_SCHEMA.names)
    ranged = merged.repartitionByRange(parts, "timestamp", "id").sortWithinPartitions(
        "event_date", "batch_id", "timestamp", "id"
    )
    _write(ranged, path, "event_date", "batch_id")
    index_files(spark, path, [day], compacted_batch(upto_batch))
    _publish(spark, path, tiers, upto_batch)
    vacuum_table(spark, path)


def _compact_ingested(spark: SparkSession, path: str, day: date, upto_batch: int, read, schema: StructType) -> None:
    """Merge the batches of one ingestion day; the rules of :func:`compact_day` hold."""
    _refuse_uncommitted(spark, path, upto_batch)
    tiers = _tiers(spark, path, [day], upto_batch, INGEST_DAY)
    if tiers:
        last = (tiers[day][0] or [-1])[-1]
        rows = read(spark, path, [day], upto_batch, origin=True).withColumnRenamed("batch_id", "source_batch")
        rows = rows.where(F.col("source_batch") > last)
        merged = _stamp(rows, compacted_batch(upto_batch)).select(*schema.names)
        ordered = merged.hint("rebalance", "source_batch", "envelope_id").sortWithinPartitions("source_batch", "envelope_id")
        _write(ordered, path, INGEST_DAY, "batch_id")
        _publish(spark, path, tiers, upto_batch, INGEST_DAY)
    vacuum_table(spark, path)


def compact_rejected(spark: SparkSession, path: str, day: date, upto_batch: int) -> None:
    """Merge the small files of the rejections received on one day."""
    _compact_ingested(spark, path, day, upto_batch, read_rejected, REJECTED_TABLE_SCHEMA)


def compact_summary(spark: SparkSession, path: str, day: date, upto_batch: int) -> None:
    """Merge the small files of the summaries of one day."""
    _compact_ingested(spark, path, day, upto_batch, read_summary, SUMMARY_TABLE_SCHEMA)


def compact_rollup(spark: SparkSession, path: str, upto_batch: int) -> None:
    """Fold the deltas of the batches up to ``upto_batch`` into one row per key and segment, on every day that got new ones."""
    _refuse_uncommitted(spark, path, upto_batch)
    tiers = _tiers(spark, path, stored_days(spark, path), upto_batch)
    if tiers:
        deltas = read_rollup(spark, path, upto_batch, list(tiers)).where(_to_merge(tiers))
        append_rollup(merge_rollup(deltas), path, compacted_batch(upto_batch))
        _publish(spark, path, tiers, upto_batch)
    vacuum_table(spark, path)
