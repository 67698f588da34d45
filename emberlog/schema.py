"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

#: The six columns a search returns.
LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("attributes", T.StringType(), False),
    ]
)

#: Stored form. ``attr_text`` holds every attribute as canonical text for filters; the last two are the
#: partition columns.
LOG_TABLE_SCHEMA = T.StructType(
    [
        *LOG_SCHEMA.fields,
        T.StructField("attr_text", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("event_date", T.DateType(), False),
        T.StructField("batch_id", T.LongType(), False),
    ]
)

ROLLUP_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("count", T.LongType(), False),
        T.StructField("event_date", T.DateType(), False),
        T.StructField("batch_id", T.LongType(), False),
    ]
)

#: Of an entry or an envelope: where it came from, and when. The last two are partition columns; compaction changes the
#: last one, so the batch is a column as well.
_ORIGIN = [
    T.StructField("file_path", T.StringType(), True),
    T.StructField("source_batch", T.LongType(), False),
    T.StructField("ingest_date", T.DateType(), False),
    T.StructField("batch_id", T.LongType(), False),
]

REJECTED_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("envelope_id", T.LongType(), False),
        T.StructField("index", T.IntegerType(), True),
        T.StructField("reason", T.StringType(), False),
        *_ORIGIN,
    ]
)

SUMMARY_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("envelope_id", T.LongType(), False),
        T.StructField("accepted", T.LongType(), False),
        T.StructField(
            "rejected",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", T.IntegerType(), False),
                        T.StructField("reason", T.StringType(), False),
                    ]
                )
            ),
            False,
        ),
        T.StructField("status", T.IntegerType(), False),
        *_ORIGIN,
    ]
)
