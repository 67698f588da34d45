"""Envelope source: JSON documents ``{"logs": [...]}``, one per line (or one per file)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.fixed_values import REASON_ENVELOPE
from emberlog.session import prepare

#: Arrival order of the splits of a batch, and the column that orders the entries within one split.
SPLIT_COLUMNS = ["file_time", "file_path", "split_start"]
ARRIVAL = "arrival"

_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _with_origin(text: DataFrame) -> DataFrame:
    """The split each line was read from, and the time the query read it."""
    return text.select(
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.current_timestamp().alias("received_at"),
        "value",
    )


def number_envelopes(envelopes: DataFrame) -> DataFrame:
    """Add ``envelope_id``, unique within the batch."""
    return envelopes.withColumn("envelope_id", F.monotonically_increasing_id())


def read_envelopes(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """``(envelope_id, value)`` and its origin for every document below ``path``."""
    return number_envelopes(_with_origin(prepare(spark).read.text(path, wholetext=whole_files)))


#: Input of a micro-batch unless the caller counts files: far fewer entries than a batch has ids for.
BATCH_BYTES = 1 << 30


def stream_envelopes(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    *,
    max_bytes: int | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Streaming form, numbered per micro-batch with :func:`number_envelopes`.

    A micro-batch takes ``max_files`` files, or ``max_bytes`` bytes of files (:data:`BATCH_BYTES` if neither is given),
    one file at least; the backlog waits in the source. ``received_at`` is fixed for a micro-batch and restored when it is replayed.
    """
    reader = prepare(spark).readStream
    if max_files is None:
        reader = reader.option("maxBytesPerTrigger", max_bytes or BATCH_BYTES)
    else:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_origin(reader.text(path, wholetext=whole_files))


def _parsed(envelopes: DataFrame) -> DataFrame:
    """Add ``_logs``. The parser ignores what follows a complete value, so the document is read as the first of two
    elements, and a document is refused unless the second one is the end mark of this query."""
    end = uuid4().hex
    document = F.from_json(
        F.concat(F.lit("["), F.col("value"), F.lit(f',{{"end":"{end}"}}]')),
        "array<struct<logs:array<variant>,end:string>>",
        _STRICT_JSON,
    )
    whole = (F.size("_doc") == 2) & F.try_element_at("_doc", F.lit(2))["end"].eqNullSafe(F.lit(end))
    carried = [c for c in envelopes.columns if c != "value"]
    return envelopes.select(*carried, document.alias("_doc")).select(
        *carried, F.when(whole, F.try_element_at("_doc", F.lit(1))["logs"]).alias("_logs")
    )


def explode_all(envelopes: DataFrame) -> DataFrame:
    """One row per entry; a refused envelope gives one row without entry that carries the reason."""
    prepare(envelopes.sparkSession)
    parsed = _parsed(envelopes)
    carried = [c for c in parsed.columns if c != "_logs"]
    # An explicit JSON null entry is a value, so an absent entry marks exactly the refused envelopes.
    return parsed.select(*carried, F.posexplode_outer("_logs").alias("index", "entry")).withColumn(
        "reason", F.when(F.col("index").isNull(), F.lit(REASON_ENVELOPE))
    )


def number_arrivals(entries: DataFrame) -> DataFrame:
    """Add ``arrival``, which rises by one per row in reading order within a split.

    The text source has no line number, but the entries of a split leave its task in file order. Must follow the
    explosion directly, before any filter.
    """
    return entries.withColumn(ARRIVAL, F.monotonically_increasing_id())


def explode_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, refused)``: ``(envelope_id, index, entry VARIANT)`` and ``(envelope_id, reason)``.

    Entries are not looked at here; a document that is no object with a non-empty ``logs`` array is refused whole.
    Both sides filter what the explosion made, so a document is parsed once and not again in a filter below it.
    """
    exploded = explode_all(envelopes)
    entries = exploded.where(F.col("index").isNotNull()).select("envelope_id", "index", "entry")
    refused = exploded.where(F.col("index").isNull()).select("envelope_id", F.lit(REASON_ENVELOPE).alias("reason"))
    return entries, refused
