"""The ``events`` test table seen as logs, as stored rows and as ingest envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import prepare


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per event; pure projection, so filters and pruning still reach the scan."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    level = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "signup", "warn")
        .when(F.col("event_type") == "view", "debug")
        .otherwise("info")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("attributes"),
    )


def _entry_json(logs: DataFrame) -> Column:
    """The log row as an entry with one seeded change picked by ``id % 16``; every row is kept."""
    case = F.col("id") % 16

    def unless(*cases: int, value: Column) -> Column:
        return F.when(~case.isin(*cases), value)

    utc = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(
        F.col("timestamp") + F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:30'"
    )
    ts = (
        F.when(case == 2, "not-a-date")
        .when(case == 10, "2999-01-01T00:00:00Z")
        .when(case == 13, shifted)
        .otherwise(F.concat(utc, F.lit("Z")))
    )
    service = (
        F.when(case == 3, "   ")
        .when(case == 11, F.concat(F.lit("  \t"), "service", F.lit("  ")))
        .otherwise(F.col("service"))
    )
    head = F.to_json(
        F.struct(
            unless(1, value=ts).alias("timestamp"),
            unless(9, value=F.when(case == 0, "critical").otherwise(F.col("level"))).alias("level"),
            unless(8, value=service).alias("service"),
            F.when(case == 4, "").otherwise(F.col("message")).alias("message"),
        )
    )
    attributes = (
        F.when(case == 5, '{"nested":{"a":1}}').when(case == 6, '{"flag":null}').otherwise(F.col("attributes"))
    )
    whole = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"attributes":'), attributes, F.lit("}"))
    return F.when(case == 7, '"bare"').when(case == 12, head).otherwise(whole)


def events_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(envelope_id, index, entry_json)``: 100 consecutive events per envelope."""
    logs = events_as_logs(spark, sf_dir)
    return logs.select(
        F.expr("id div 100").alias("envelope_id"),
        (F.col("id") % 100).cast("int").alias("index"),
        _entry_json(logs).alias("entry_json"),
    )


def events_as_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(envelope_id, value)``: whole documents of at most 100 entries each."""
    entries = F.array_sort(F.collect_list(F.struct("index", "entry_json")))
    joined = F.array_join(F.transform("entries", lambda e: e["entry_json"]), ",")
    return (
        events_as_entries(spark, sf_dir)
        .groupBy("envelope_id")
        .agg(entries.alias("entries"))
        .select("envelope_id", F.concat(F.lit('{"logs":['), joined, F.lit("]}")).alias("value"))
    )


def events_with_other_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(envelope_id, value)``: the same envelopes with the changes that ``id % 12`` picks from a second list.

    Instants that the calendar does not have, a message that is missing or a number, attributes of four wrong types,
    texts that are one character too long; the last two cases are accepted.
    """
    logs = events_as_logs(spark, sf_dir)
    case = F.col("id") % 12
    utc = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    ts = F.when(case == 0, "2024-02-30T10:00:00Z").when(case == 1, "2024-01-05T25:00:00Z").otherwise(utc)
    service = F.when(case == 8, "s" * 101).when(case == 10, "s" * 100).otherwise(F.col("service"))
    message = F.when(case == 9, "m" * 1001).when(case == 11, "m" * 1000).otherwise(F.col("message"))
    quoted = F.when(case == 3, F.lit("17")).otherwise(F.concat(F.lit('"'), message, F.lit('"')))
    attributes = (
        F.when(case == 4, "null").when(case == 5, '"text"').when(case == 6, '["a"]').when(case == 7, "5").otherwise(F.col("attributes"))
    )
    entry = F.concat(
        F.lit('{"timestamp":"'), ts, F.lit('","level":"'), F.col("level"), F.lit('","service":"'), service, F.lit('"'),
        F.when(case == 2, "").otherwise(F.concat(F.lit(',"message":'), quoted)),
        F.lit(',"attributes":'), attributes, F.lit("}"),
    )
    numbered = logs.select(F.expr("id div 100").alias("envelope_id"), F.struct((F.col("id") % 100).alias("index"), entry.alias("entry")).alias("e"))
    entries = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"])
    joined = numbered.groupBy("envelope_id").agg(entries.alias("entries"))
    return joined.select("envelope_id", F.concat(F.lit('{"logs":['), F.array_join("entries", ","), F.lit("]}")).alias("value"))
