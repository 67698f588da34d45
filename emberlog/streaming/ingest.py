"""Micro-batch ingestion: envelopes in, logs, rollup, rejections and summaries out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.fixed_values import FLUSH_INTERVAL
from emberlog.operators.aggregate import rollup_batch
from emberlog.operators.identity import assign_ids_by_split
from emberlog.operators.validate import check_entries, summarise
from emberlog.plans.storage import append_logs, append_rejected, append_rollup, append_summary, drop_batch
from emberlog.sources.envelopes import (
    ARRIVAL,
    SPLIT_COLUMNS,
    explode_all,
    number_arrivals,
    number_envelopes,
    read_envelopes,
    stream_envelopes,
)
from emberlog.sources.commits import claim_writer, commit, committed_batch, last_measure, refuse_gap, refuse_replaced
from emberlog.sources.files import child_names, delete, exists, touch

#: Marks of batches that were begun; one that is there already belongs to a batch that is being replayed.
_BEGUN = "begun"
#: Name of the bytes of an entry in the commit log, and what is assumed before a batch was measured.
ENTRY_BYTES, ASSUMED_ENTRY_BYTES = "entry_bytes", 200


def check_batch(envelopes: DataFrame) -> DataFrame:
    """Every entry of a batch with its number and verdict.

    The future rule compares with ``received_at``, which a replayed micro-batch gets back unchanged, so it decides
    the same way again.
    """
    return check_entries(number_arrivals(explode_all(envelopes)), F.col("received_at"))


def flush_batch(
    envelopes: DataFrame, root: str, batch_id: int, writer: int | None = None, *, measure: bool = False
) -> None:
    """Write one batch: rows, rollup, rejections and summaries side by side, then its entry in the commit log.

    The verdicts are kept for the four writes (a lost block is recomputed from the source). A batch that fails
    half-way is written again in full under the same number; what it left is removed first, whatever days it was in.
    A batch is refused while the one before it is missing, and so is a ``writer`` that another has followed. ``measure``
    puts the bytes of an entry into the commit log, for the admission by entries of :func:`start_ingest`.
    """
    spark, base = envelopes.sparkSession, root.rstrip("/")
    refuse_gap(spark, base, batch_id)
    refuse_replaced(spark, base, writer)
    begun = f"{base}/{_BEGUN}/{batch_id}"
    if exists(spark, begun):
        drop_batch(spark, base, batch_id)
    touch(spark, begun)
    kept = check_batch(envelopes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The count over the splits fills the cache that the writes then share.
        numbered = assign_ids_by_split(kept, batch_id, SPLIT_COLUMNS, ARRIVAL)
        accepted, rejected = F.col("reason").isNull(), F.col("reason").isNotNull()
        _side_by_side(
            spark,
            lambda: append_logs(numbered.where(accepted), f"{base}/logs", batch_id),
            lambda: append_rollup(rollup_batch(kept.where(accepted)), f"{base}/rollup", batch_id),
            lambda: append_rejected(kept.where(rejected), f"{base}/rejected", batch_id),
            lambda: append_summary(summarise(kept, "file_path", "received_at"), f"{base}/summary", batch_id),
        )
        for old in commit(spark, base, batch_id, writer, _measures(kept) if measure else None):
            delete(spark, f"{base}/{_BEGUN}/{old}")
    finally:
        kept.unpersist()


def _measures(kept: DataFrame) -> dict[str, float]:
    """Bytes of an entry of this batch, from the sizes of its files and the verdicts that are in memory anyway."""
    files = kept.groupBy("file_path").agg(F.count("*").alias("entries"), F.max("file_size").alias("bytes"))
    total = files.agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes")).first()
    return {ENTRY_BYTES: total.bytes / total.entries} if total.entries else {}


def _side_by_side(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run independent jobs at once: a short batch is mostly their planning and commits. Fails if any of them does."""
    with ThreadPoolExecutor(len(writes)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
    for job in running:
        job.result()


def ingest_files(spark: SparkSession, in_path: str, root: str, batch_id: int, *, replace: bool = False) -> None:
    """One bounded batch without a stream.

    A number up to the last committed batch is refused unless ``replace`` says that its rows are to go, and so is one
    that leaves out a batch.
    """
    last = committed_batch(spark, root)
    if last is not None and batch_id <= last:
        if not replace:
            raise ValueError(f"batch {batch_id} may be there already: pass {last + 1}, or replace=True")
        drop_batch(spark, root, batch_id)
    flush_batch(read_envelopes(spark, in_path), root, batch_id)


def start_ingest(
    spark: SparkSession,
    in_path: str,
    root: str,
    checkpoint: str,
    *,
    interval: str | None = FLUSH_INTERVAL,
    max_files: int | None = None,
    max_entries: int | None = None,
    first_batch: int = 0,
) -> StreamingQuery:
    """Start ingestion; ``interval=None`` works off what is there and stops.

    A micro-batch takes ``max_files`` files, or files of about ``max_entries`` entries by the bytes that an entry of the
    last measured batch had (:data:`ASSUMED_ENTRY_BYTES` before the first), one file at least. The source fixes its
    limit when it starts, so a changed size of entries counts from the next start.

    Batches are numbered from ``first_batch``. A new checkpoint over a table that already has batches would
    overwrite them or leave some out, so it has to start with the next one. Starting makes this the table's only writer:
    an earlier one that is still alive fails at its next batch.
    """
    last = committed_batch(spark, root)
    if not child_names(spark, f"{checkpoint.rstrip('/')}/offsets") and last is not None and last + 1 != first_batch:
        raise ValueError(f"new checkpoint over an existing table: pass first_batch={last + 1}")
    writer = claim_writer(spark, root)
    max_bytes = None
    if max_entries is not None:
        max_bytes = max(1, int(max_entries * (last_measure(spark, root, ENTRY_BYTES) or ASSUMED_ENTRY_BYTES)))
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}

    def flush(batch: DataFrame, number: int) -> None:
        flush_batch(number_envelopes(batch), root, first_batch + number, writer, measure=max_entries is not None)

    return (
        stream_envelopes(spark, in_path, max_files, max_bytes=max_bytes)
        .writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stop_ingest(query: StreamingQuery) -> None:
    """Work off everything that has arrived, then stop."""
    query.processAllAvailable()
    query.stop()
