
from __future__ import annotations

import base64
from collections.abc import Callable
from datetime import date
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.cursors import decode_cursor, encode_cursor
from emberlog.functions.timestamps import iso_millis
from emberlog.functions.variants import attribute_text_of_json
from emberlog.operators.aggregate import (
    aggregate_logs,
    aggregate_rollup,
    count_logs,
    format_buckets,
    merge_rollup,
    rollup_batch,
)
from emberlog.operators.filters import apply_filters
from emberlog.operators.identity import assign_ids
from emberlog.operators.paging import log_page, number_pages, page_bounds
from emberlog.operators.search import format_logs, search_logs
from emberlog.operators.validate import check_entries, summarise, validate_entries
from emberlog.plans.auto_aggregate import aggregate_auto, aggregate_table
from emberlog.plans.recent_search import search_days
from emberlog.plans.retention import expire_ingested, expired_days, list_log_days, run_retention
from emberlog.plans.storage import (
    append_logs,
    append_rejected,
    append_rollup,
    append_summary,
    compact_day,
    compact_rejected,
    compact_rollup,
    compact_summary,
    vacuum_table,
    with_event_date,
)
from emberlog.plans.table_search import search_table, walk_table
from emberlog.session import prepare, scratch_path
from emberlog.sources.commits import commit
from emberlog.sources.envelopes import explode_envelopes, read_envelopes
from emberlog.sources.events import events_as_entries, events_as_envelopes, events_as_logs, events_with_other_defects
from emberlog.sources.tables import read_logs, read_rejected, read_rollup, read_summary
from emberlog.streaming.ingest import flush_batch, start_ingest, stop_ingest
from emberlog.streaming.live_rollup import stream_rollup

Query = Callable[[SparkSession, str], DataFrame]

# Request parameters used below. The bounds are deliberately not on a minute.
SINCE, UNTIL = "2024-01-05T06:07:08.5Z", "2024-01-20T18:00:30.25Z"
SINCE_SQL, UNTIL_SQL = "TIMESTAMP '2024-01-05 06:07:08.5'", "TIMESTAMP '2024-01-20 18:00:30.25'"
START, END = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"
TODAY, KEEP_DAYS = date(2024, 2, 10), 30
COMPACTED_DAY = date(2024, 1, 10)
CURSOR_BODY = '{"timestamp":"2024-01-15T00:00:00.000000Z","id":"5000"}'


def _naive(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC timestamps, the type the SQL side has."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _over_logs(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _naive(query(events_as_logs(spark, sf_dir)))


def _search(**params) -> Query:
    return _over_logs(lambda logs: search_logs(logs, **params))


def _aggregate(since: str, until: str, bucket: str, **params) -> Query:
    return _over_logs(lambda logs: aggregate_logs(logs, since, until, bucket, **params))


def _more_attributes(logs: DataFrame) -> DataFrame:
    """A boolean, a decimal with trailing zeros and a key holding a dot next to the stored attribute."""
    extra = F.concat(
        F.lit(', "even": '),
        (F.col("id") % 2 == 0).cast("string"),
        F.lit(', "size.mb": '),
        (F.col("id") % 5).cast("string"),
        F.lit(".50}"),
    )
    return logs.withColumn("attributes", F.concat(F.rtrim("attributes", F.lit("}")), extra))


# --- stored tables -----------------------------------------------------------------------------------------------


@cache
def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The table shared by the queries that only read it, written once per session."""
    return _store(spark, sf_dir)


@cache
def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """The same for the queries over what the stream wrote."""
    return _ingest(spark, sf_dir)


@cache
def _committed(spark: SparkSession, sf_dir: str) -> str:
    """The same with its batches committed and its files indexed."""
    return _store(spark, sf_dir, committed=True)


def _store(spark: SparkSession, sf_dir: str, *, committed: bool = False) -> str:
    """The whole events table stored as three batches of logs and rollup deltas; returns the root folder."""
    logs = events_as_logs(spark, sf_dir)
    stored = logs.withColumn(
        "attr_text", attribute_text_of_json("attributes")
    ).withColumn("_batch", F.expr("id div 1000 % 3"))
    root = scratch_path(spark, "table")
    for batch in range(3):
        part = stored.where(F.col("_batch") == batch)
        append_logs(part, f"{root}/logs", batch, index=committed)
        append_rollup(rollup_batch(part), f"{root}/rollup", batch)
        if committed:
            commit(spark, root, batch)
    return root


def _table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read_logs(spark, f"{_stored(spark, sf_dir)}/logs")
    return _naive(search_logs(logs, since=SINCE, until=UNTIL, attrs={"k": 42}, limit=1000))


def _table_page(**params) -> Query:
    """A page of the committed rows with the token of the next, which carries the snapshot."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = search_table(spark, _committed(spark, sf_dir), **params)
        return _naive(page.rows.withColumn("next_cursor", F.lit(page.next_cursor).cast("string")))

    return run


def _table_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, page = walk_table(spark, _committed(spark, sf_dir), level="warn", until=UNTIL, limit=1000)
    return _naive(page.rows.withColumn("next_cursor", F.lit(page.next_cursor).cast("string")))


def _table_page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a walk: its number, size, ends and the token that leads on."""
    pages = []
    for number, page in enumerate(walk_table(spark, _committed(spark, sf_dir), service="svc-6", limit=1000), 1):
        ids = [row.id for row in page.rows.select("id").collect()]
        pages.append((number, len(ids), ids[0], ids[-1], page.next_cursor))
    return spark.createDataFrame(pages, "page_no int, count int, first_id long, last_id long, next_cursor string")


def _table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a walk, asked for after another batch came and its days were compacted."""
    root = _store(spark, sf_dir, committed=True)
    first = search_table(spark, root, limit=100)
    again = read_logs(spark, f"{root}/logs", 0).drop("event_date", "batch_id")
    append_logs(again, f"{root}/logs", 3)
    commit(spark, root, 3)
    for row in with_event_date(first.rows).select("event_date").distinct().collect():
        compact_day(spark, f"{root}/logs", row.event_date, 3)
    return _naive(search_table(spark, root, limit=100, cursor=first.next_cursor).rows)


def _vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day after compaction of all batches, when nothing but the compacted folder is left."""
    path = f"{_store(spark, sf_dir)}/logs"
    compact_day(spark, path, COMPACTED_DAY, 2)
    vacuum_table(spark, path, 0)
    day = read_logs(spark, path, days=[COMPACTED_DAY])
    return day.groupBy("event_date").agg(
        F.count("*").alias("count"), F.sum("id").cast("long").alias("id_sum"), F.count_distinct("batch_id").alias("folders")
    )


def _table_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_stored(spark, sf_dir)}/logs"
    days = [row.event_date for row in list_log_days(spark, path).select("event_date").collect()]
    return _naive(search_days(read_logs(spark, path), days, service="svc-1", limit=150).rows)


def _table_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read_logs(spark, f"{_stored(spark, sf_dir)}/logs")
    return _naive(aggregate_logs(logs, SINCE, UNTIL, "1h", group_by="level"))


def _day_totals(logs: DataFrame) -> DataFrame:
    return logs.groupBy("event_date").agg(
        F.count("*").alias("count"), F.sum("id").cast("long").alias("id_sum"), F.count_distinct("attributes").alias("kinds")
    )


def _compacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_store(spark, sf_dir)}/logs"
    compact_day(spark, path, COMPACTED_DAY, 1)
    return _day_totals(read_logs(spark, path))


def _compacted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_store(spark, sf_dir)}/rollup"
    compact_rollup(spark, path, 2)
    # Compacted on every day, so the stored rows are the merged ones.
    return _naive(read_rollup(spark, path).select("bucket_start", "service", "level", "count"))


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_store(spark, sf_dir)}/logs"
    run_retention(spark, path, KEEP_DAYS, TODAY)
    return _day_totals(read_logs(spark, path))


def _rollup_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_rollup(spark, f"{_stored(spark, sf_dir)}/rollup")


def _auto(bucket: str, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _stored(spark, sf_dir)
        logs, rollup = read_logs(spark, f"{root}/logs"), read_rollup(spark, f"{root}/rollup")
        return _naive(aggregate_auto(logs, rollup, SINCE, UNTIL, bucket, **params))

    return run


# --- ingestion ---------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_envelopes(events_as_envelopes(spark, sf_dir))[0]


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = validate_entries(_entries(spark, sf_dir))
    return _naive(
        accepted.select(
            "envelope_id",
            "index",
            "timestamp",
            "level",
            "service",
            "message",
            "attributes",
            F.try_element_at("attr_text", F.lit("k")).alias("attr_k"),
        )
    )


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = summarise(check_entries(_entries(spark, sf_dir)))
    return summary.withColumn("rejected", F.to_json("rejected"))


def _broken_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every envelope, with its document damaged in one of seven ways or left alone."""
    case = F.col("envelope_id") % 8
    value = F.col("value")
    return events_as_envelopes(spark, sf_dir).withColumn(
        "value",
        F.when(case == 0, '{"logs":[]}')
        .when(case == 1, F.concat(F.lit("["), value, F.lit("]")))
        .when(case == 2, F.replace(value, F.lit('{"logs":'), F.lit('{"log":')))
        .when(case == 3, '{"logs":"text"}')
        .when(case == 4, F.concat(value, F.lit("x")))
        .when(case == 5, F.rtrim(value, F.lit("}")))
        .when(case == 6, F.concat(value, value))
        .otherwise(value),
    )


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_envelopes(_broken_envelopes(spark, sf_dir))[1]


def _envelope_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _ = explode_envelopes(_broken_envelopes(spark, sf_dir))
    return entries.groupBy("envelope_id").agg(
        F.count("*").alias("entries"), F.max("index").alias("last_index")
    )


def _ingest(spark: SparkSession, sf_dir: str) -> str:
    """The whole events table sent through the ingestion stream; returns the root folder."""
    source, root = scratch_path(spark, "incoming"), scratch_path(spark, "ingested")
    events_as_envelopes(spark, sf_dir).select("value").write.text(source)
    query = start_ingest(spark, source, root, scratch_path(spark, "offsets"), interval=None, max_files=3)
    query.awaitTermination()
    return root


def _envelope_files(spark: SparkSession, sf_dir: str, part: int | None = None) -> str:
    """A folder with the events as envelopes in several files; ``part`` takes the even or the odd envelopes."""
    source = scratch_path(spark, "incoming")
    envelopes = events_as_envelopes(spark, sf_dir)
    if part is not None:
        envelopes = envelopes.where(F.col("envelope_id") % 2 == part)
    envelopes.repartition(6, "envelope_id").select("value").write.text(source)
    return source


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once, though the batch was written twice."""
    root, source = scratch_path(spark, "replayed"), _envelope_files(spark, sf_dir)
    for _ in range(2):
        flush_batch(read_envelopes(spark, source), root, 0)
    logs = read_logs(spark, f"{root}/logs").groupBy("service", "level").agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids"))
    counted = merge_rollup(read_rollup(spark, f"{root}/rollup")).groupBy("service", "level").agg(F.sum("count").alias("rollup"))
    return logs.join(counted, ["service", "level"])


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from the rollup after a second batch brought rows for minutes that had been counted and compacted."""
    root = scratch_path(spark, "late")
    flush_batch(read_envelopes(spark, _envelope_files(spark, sf_dir, 0)), root, 0)
    compact_rollup(spark, f"{root}/rollup", 0)
    flush_batch(read_envelopes(spark, _envelope_files(spark, sf_dir, 1)), root, 1)
    return _naive(aggregate_table(spark, root, SINCE, UNTIL, "1m", group_by="level"))


def _verdicts(spark: SparkSession, sf_dir: str) -> str:
    """Rejections and summaries in three batches, received when the first event of their envelope happened."""
    root = scratch_path(spark, "verdicts")
    starts = events_as_logs(spark, sf_dir).groupBy(F.expr("id div 100").alias("envelope_id")).agg(F.min("timestamp").alias("received_at"))
    checked = check_entries(_entries(spark, sf_dir)).select("envelope_id", "index", "reason").join(starts, "envelope_id")
    checked = checked.withColumn("file_path", F.concat(F.lit("file-"), F.expr("envelope_id div 10").cast("string")))
    for batch in range(3):
        part = checked.where(F.col("envelope_id") % 3 == batch)
        append_rejected(part.where("reason IS NOT NULL"), f"{root}/rejected", batch)
        append_summary(summarise(part, "file_path", "received_at"), f"{root}/summary", batch)
    return root


def _rejected_of(spark: SparkSession, root: str) -> DataFrame:
    rejected = read_rejected(spark, f"{root}/rejected", origin=True)
    return rejected.groupBy("ingest_date", "batch_id", "file_path").agg(F.count("*").alias("count"))


def _compacted_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _verdicts(spark, sf_dir)
    compact_rejected(spark, f"{root}/rejected", date(2024, 1, 1), 1)
    vacuum_table(spark, f"{root}/rejected", 0)
    return _rejected_of(spark, root)


def _compacted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _verdicts(spark, sf_dir)
    compact_summary(spark, f"{root}/summary", date(2024, 1, 1), 2)
    vacuum_table(spark, f"{root}/summary", 0)
    summary = read_summary(spark, f"{root}/summary", origin=True)
    return summary.groupBy("ingest_date", "status").agg(
        F.count("*").alias("envelopes"),
        F.sum("accepted").cast("long").alias("accepted"),
        F.sum(F.size("rejected")).cast("long").alias("rejected"),
        F.count_distinct("file_path").alias("files"),
    )


def _expired_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _verdicts(spark, sf_dir)
    expire_ingested(spark, f"{root}/rejected", 0, date(2024, 1, 2))
    return _rejected_of(spark, root)


def _stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backlog admitted by entries: several micro-batches, each with a part of the rows, none lost. After the first
    half the limit goes by the size that its entries had."""
    root, offsets = scratch_path(spark, "batches"), scratch_path(spark, "offsets")
    source, rest = _envelope_files(spark, sf_dir, 0), _envelope_files(spark, sf_dir, 1)
    limit = count_logs(events_as_logs(spark, sf_dir)).first()[0] // 10 + 1
    start_ingest(spark, source, root, offsets, interval=None, max_entries=limit).awaitTermination()
    spark.read.text(rest).repartition(6).write.mode("append").text(source)
    start_ingest(spark, source, root, offsets, interval=None, max_entries=limit).awaitTermination()
    logs = read_logs(spark, f"{root}/logs")
    sizes = logs.groupBy("batch_id").agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids"))
    return sizes.agg(
        F.sum("count").alias("count"),
        F.sum("ids").alias("ids"),
        (F.count("*") >= 3).alias("several"),
        (F.max("count") < F.sum("count")).alias("spread"),
    )


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream leaves that is stopped right after more envelopes came: everything."""
    root, source = scratch_path(spark, "drained"), _envelope_files(spark, sf_dir, 0)
    query = start_ingest(spark, source, root, scratch_path(spark, "offsets"))
    spark.read.text(_envelope_files(spark, sf_dir, 1)).write.mode("append").text(source)
    stop_ingest(query)
    return read_logs(spark, f"{root}/logs").groupBy("level").agg(F.count("*").alias("count"))


def _stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read_logs(spark, f"{_ingested(spark, sf_dir)}/logs")
    return _naive(logs.select("timestamp", "level", "service", "message", "attributes"))


def _stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read_logs(spark, f"{_ingested(spark, sf_dir)}/logs")
    return logs.agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids"))


def _stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(merge_rollup(read_rollup(spark, f"{_ingested(spark, sf_dir)}/rollup")))


def _stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = read_rejected(spark, f"{_ingested(spark, sf_dir)}/rejected")
    return rejected.groupBy("index", "reason").agg(F.count("*").alias("count"))


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = read_summary(spark, f"{_ingested(spark, sf_dir)}/summary")
    return summary.groupBy("status").agg(
        F.count("*").alias("envelopes"),
        F.sum("accepted").cast("long").alias("accepted"),
        F.sum(F.size("rejected")).cast("long").alias("rejected"),
    )


def _stream_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(aggregate_table(spark, _ingested(spark, sf_dir), SINCE, UNTIL, "1m", group_by="service"))


def _live_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running counts in update mode; the last value of a key is its largest."""
    logs = events_as_logs(spark, sf_dir).select("timestamp", "service", "level")
    source, out = scratch_path(spark, "live"), scratch_path(spark, "counts")
    logs.write.parquet(source)
    stream = spark.readStream.schema(logs.schema).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = (
        stream_rollup(stream, watermark="60 days")
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counts = spark.read.parquet(out).groupBy("bucket_start", "service", "level")
    return _naive(counts.agg(F.max("count").alias("count")))


# --- cursors and pages -------------------------------------------------------------------------------------------


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = log_page(events_as_logs(spark, sf_dir), level="error", limit=50)
    return _naive(page.rows.withColumn("next_cursor", F.lit(page.next_cursor)))


def _decoded(logs: DataFrame) -> DataFrame:
    """Four kinds of token in turn: full resolution, milliseconds, numeric id (bad) and damaged text (bad)."""
    case = F.col("id") % 4
    body = F.concat(F.lit('{"timestamp":"'), iso_millis(F.col("timestamp")), F.lit('","id":'))
    quoted = F.concat(body, F.lit('"'), F.col("id").cast("string"), F.lit('"}'))
    bare = F.concat(body, F.col("id").cast("string"), F.lit("}"))
    token = (
        F.when(case == 0, encode_cursor(F.col("timestamp"), F.col("id")))
        .when(case == 1, F.base64(F.encode(quoted, "UTF-8")))
        .when(case == 2, F.base64(F.encode(bare, "UTF-8")))
        .otherwise(F.concat(F.lit("*"), F.col("message")))
    )
    decoded = logs.select(F.col("id").alias("row_id"), decode_cursor(token).alias("c"))
    return decoded.select("row_id", F.col("c.timestamp").alias("cursor_timestamp"), F.col("c.id").alias("cursor_id"))


def _documents_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return apply_filters(documents.withColumnRenamed("text", "message"), q="The%data").select("doc_id", "lang")


def entry(spark: SparkSession) -> DataFrame:
    """Counts per five minutes and service over one day."""
    logs = events_as_logs(spark, "/root/testdata/sf0.001")
    return _naive(aggregate_logs(logs, "2024-01-10T00:00:00Z", "2024-01-11T00:00:00Z", "5m", group_by="service"))


def _optional() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the subpackage ``llm`` and of the corpus pipeline, as far as they are there.

    The pipeline needs the subpackage, so either of the two may be what is missing.
    """
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in ("emberlog.llm.queries", "corpus_pipeline"):
        try:
            added = import_module(module)
        except ModuleNotFoundError as missing:
            if missing.name not in ("corpus_pipeline", "emberlog.llm") and not str(missing.name).startswith("emberlog.llm."):
                raise
        else:
            found |= added.QUERIES
            sql |= added.ORACLE_SQL if isinstance(added.ORACLE_SQL, dict) else {}
    return found, sql


def queries() -> dict[str, Query]:
    """Every registered query."""
    return core_queries() | _optional()[0]


def oracle_sql() -> dict[str, str]:
    """The DuckDB counterparts; a query without one is tested against brute force."""
    return core_oracle_sql() | _optional()[1]


def core_queries() -> dict[str, Query]:
    """One entry per operator; every one reads its whole table."""
    return {
        "search_all": _search(),
        "search_service": _search(service=" svc-3 "),
        "search_level": _search(level="error"),
        "search_since_until": _search(since=SINCE, until=UNTIL, limit=1000),
        "search_q": _search(q="CLICK by"),
        "search_q_wildcard": _search(q="p_rch%USER 1_"),
        "search_q_escape": _search(q="by\\ us\\er 1"),
        "search_attr": _search(attrs={"k": 42}),
        "search_attr_multi": _over_logs(
            lambda logs: search_logs(_more_attributes(logs), attrs={"k": "42", "even": True, "size.mb": "2.5"})
        ),
        "search_attr_missing": _search(attrs={"absent": "x"}),
        "search_combined": _search(service="svc-2", level="info", since=SINCE, until=UNTIL, q="click", attrs={"k": "7"}),
        "search_limit1": _search(limit=1),
        "search_after_cursor": _search(cursor=base64.urlsafe_b64encode(CURSOR_BODY.encode()).decode().rstrip("=")),
        "search_formatted": _over_logs(lambda logs: format_logs(search_logs(logs, limit=1000))),
        "filter_conjunction": _over_logs(lambda logs: apply_filters(logs, service="svc-5", level="warn", until=UNTIL)),
        "filter_documents": _documents_matching,
        "page_numbers": _over_logs(lambda logs: number_pages(logs, 100)),
        "page_next_cursor": _page,
        "page_walk": _over_logs(lambda logs: page_bounds(logs, 100, level="info")),
        "cursor_encode": _over_logs(
            lambda logs: logs.select("id", encode_cursor(F.col("timestamp"), F.col("id")).alias("token"))
        ),
        "cursor_decode": _over_logs(_decoded),
        "agg_1m": _aggregate(START, END, "1m"),
        "agg_5m": _aggregate(SINCE, UNTIL, "5m"),
        "agg_1h": _aggregate(SINCE, UNTIL, "1h"),
        "agg_1d": _aggregate(START, END, "1d"),
        "agg_by_service": _aggregate(START, END, "5m", group_by="service"),
        "agg_by_level": _aggregate(START, END, "1h", group_by="level"),
        "agg_filtered": _aggregate(SINCE, UNTIL, "1h", group_by="service", level="error"),
        "agg_q": _aggregate(START, END, "1d", q="PURCHASE"),
        "agg_attr": _aggregate(START, END, "1d", group_by="level", attrs={"k": "42"}),
        "agg_empty_range": _aggregate(SINCE, SINCE, "1m"),
        "agg_formatted": _over_logs(lambda logs: format_buckets(aggregate_logs(logs, START, END, "1h", group_by="level"))),
        "rollup_batch": _over_logs(rollup_batch),
        "rollup_merge": lambda spark, sf_dir: _naive(merge_rollup(_rollup_of(spark, sf_dir))),
        "agg_rollup_1m": lambda spark, sf_dir: _naive(
            aggregate_rollup(_rollup_of(spark, sf_dir), SINCE, UNTIL, group_by="service", level="info")
        ),
        "agg_auto_unaligned": _auto("1m", group_by="level"),
        "agg_auto_hours": _auto("1h", service="svc-4", any_bucket=True),
        "agg_auto_ineligible": _auto("1m", q="signup"),
        "envelope_entries": _envelope_entries,
        "envelope_refused": _refused,
        "validate_accepted": _accepted,
        "validate_rejected": lambda spark, sf_dir: validate_entries(_entries(spark, sf_dir))[1],
        "validate_other_defects": lambda spark, sf_dir: validate_entries(
            explode_envelopes(events_with_other_defects(spark, sf_dir))[0]
        )[1],
        "ingest_summary": _summary,
        "event_date_assign": _over_logs(lambda logs: with_event_date(logs).select("id", "event_date")),
        "id_assign": _over_logs(
            lambda logs: assign_ids(
                logs.withColumnRenamed("id", "event_id"), 7, [F.asc("timestamp"), F.asc("event_id")]
            ).select("event_id", "id")
        ),
        "count_logs": _over_logs(count_logs),
        "table_search": _table_search,
        "table_recent": _table_recent,
        "table_page": _table_page(service="svc-3", until=UNTIL, limit=50),
        "table_last_page": _table_last_page,
        "table_page_walk": _table_page_walk,
        "table_snapshot": _table_snapshot,
        "table_search_q": _table_page(q="p_rch%USER \\1_", limit=200),
        "table_search_attrs": _table_page(attrs={"k": 42}, q="click", limit=100),
        "table_vacuumed": _vacuumed,
        "table_aggregate": _table_aggregate,
        "compact_day": _compacted_logs,
        "compact_rollup": _compacted_rollup,
        "log_days": lambda spark, sf_dir: list_log_days(spark, f"{_stored(spark, sf_dir)}/logs").select("event_date"),
        "expired_days": lambda spark, sf_dir: expired_days(
            list_log_days(spark, f"{_stored(spark, sf_dir)}/logs").select("event_date"), KEEP_DAYS, TODAY
        ),
        "retention": _retained,
        "stream_logs": _stream_logs,
        "stream_ids": _stream_ids,
        "stream_rollup": _stream_rollup,
        "stream_rejected": _stream_rejected,
        "stream_summary": _stream_summary,
        "stream_aggregate": _stream_aggregate,
        "stream_live_rollup": _live_rollup,
        "compact_rejected": _compacted_rejected,
        "compact_summary": _compacted_summary,
        "expired_rejected": _expired_rejected,
        "stream_batches": _stream_batches,
        "stream_drained": _drained,
        "replayed_batch": _replayed,
        "late_batch": _late,
    }


# --- DuckDB counterparts -----------------------------------------------------------------------------------------

_LOGS = """WITH logs AS (
  SELECT event_id AS id, ts AS "timestamp",
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
         concat('svc-', CAST(user_id % 8 AS VARCHAR)) AS service,
         concat(event_type, ' by user ', CAST(user_id AS VARCHAR)) AS message,
         props AS attributes
  FROM events)"""

_SIX = 'id, "timestamp", level, service, message, attributes'
_NEWEST = 'ORDER BY "timestamp" DESC, id DESC'
_RANGE = f'"timestamp" >= {SINCE_SQL} AND "timestamp" < {UNTIL_SQL}'
_WHOLE = "\"timestamp\" >= TIMESTAMP '2024-01-01' AND \"timestamp\" < TIMESTAMP '2024-02-01'"
_TOKEN = """rtrim(translate(base64(encode(concat('{"timestamp":"', strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'),
  'Z","id":"', CAST(id AS VARCHAR), '"}'))), '+/', '-_'), '=')"""

_SNAPSHOT_TOKEN = """rtrim(translate(base64(encode(concat('{"timestamp":"', strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'),
  'Z","id":"', CAST(id AS VARCHAR), '","batch":2,"generation":-1}'))), '+/', '-_'), '=')"""

# Fate of an entry by event_id % 16: the seeded defect's reason, or NULL where it is accepted.
_CHECKED = (
    _LOGS
    + """, checked AS (
  SELECT id // 100 AS envelope_id, CAST(id % 100 AS INTEGER) AS index, id,
         "timestamp", level, service, message,
         CASE WHEN id % 16 = 12 THEN '{}' ELSE replace(attributes, ' ', '') END AS attributes,
         CASE WHEN id % 16 = 12 THEN NULL ELSE attributes ->> 'k' END AS attr_k,
         CASE id % 16
           WHEN 0 THEN 'invalid level: ''critical'''
           WHEN 1 THEN 'timestamp is required'
           WHEN 2 THEN 'invalid timestamp: ''not-a-date'''
           WHEN 3 THEN 'service must be a non-empty string'
           WHEN 4 THEN 'message must be a non-empty string'
           WHEN 5 THEN 'attributes must be a flat object with string, number, or boolean values'
           WHEN 6 THEN 'attributes must be a flat object with string, number, or boolean values'
           WHEN 7 THEN 'invalid entry'
           WHEN 8 THEN 'service is required'
           WHEN 9 THEN 'invalid level: ''undefined'''
           WHEN 10 THEN 'timestamp is too far in the future: ''2999-01-01T00:00:00Z'''
         END AS reason
  FROM logs)"""
)


_VERDICTS = (
    _CHECKED
    + """, verdicts AS (
  SELECT envelope_id, index, reason, envelope_id % 3 AS batch_id, concat('file-', CAST(envelope_id // 10 AS VARCHAR)) AS file_path,
         CAST(min(logs."timestamp") OVER (PARTITION BY envelope_id) AS DATE) AS ingest_date
  FROM checked JOIN logs USING (id))"""
)


def _search_sql(condition: str = "TRUE", limit: int = 100) -> str:
    return f"{_LOGS} SELECT {_SIX} FROM logs WHERE {condition} {_NEWEST} LIMIT {limit}"


def _page_sql(condition: str, limit: int) -> str:
    """A first page; its token is that of the last row if there are more."""
    return f"""{_LOGS}, found AS (SELECT *, row_number() OVER ({_NEWEST}) AS place, count(*) OVER () AS total FROM logs WHERE {condition})
SELECT {_SIX}, (SELECT {_SNAPSHOT_TOKEN} FROM found WHERE place = {limit} AND total > {limit}) AS next_cursor
FROM found WHERE place <= {limit}"""


def _bucket_sql(width: str, instant: str = '"timestamp"') -> str:
    return f"time_bucket(INTERVAL '{width}', {instant}, TIMESTAMP '1970-01-01')"


def _aggregate_sql(width: str, condition: str, group: str | None = None, source: str = "logs", head: str = _LOGS) -> str:
    value = group or "CAST(NULL AS VARCHAR)"
    keys = "1" if group is None else "1, 2"
    return (
        f"{head} SELECT {_bucket_sql(width)} AS bucket_start, {value} AS group_value, count(*) AS count "
        f"FROM {source} WHERE {condition} GROUP BY {keys} ORDER BY {keys}"
    )


_MINUTES_SQL = f"""{_LOGS} SELECT {_bucket_sql('1 minute')} AS bucket_start, service, level, count(*) AS count
FROM logs GROUP BY 1, 2, 3"""
_TOTALS_SQL = """SELECT CAST("timestamp" AS DATE) AS event_date, count(*) AS count, CAST(sum(id) AS BIGINT) AS id_sum,
  count(DISTINCT attributes) AS kinds FROM logs"""


def core_oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL."""
    return {
        "search_all": _search_sql(),
        "search_service": _search_sql("service = 'svc-3'"),
        "search_level": _search_sql("level = 'error'"),
        "search_since_until": _search_sql(_RANGE, 1000),
        "search_q": _search_sql("message ILIKE '%CLICK by%'"),
        "search_q_wildcard": _search_sql("message ILIKE '%p_rch%USER 1_%'"),
        "search_q_escape": _search_sql("message ILIKE '%by user 1%'"),
        "search_attr": _search_sql("attributes ->> 'k' = '42'"),
        "search_attr_multi": f"""{_LOGS}, wide AS (SELECT * REPLACE (concat(rtrim(attributes, '}}'), ', "even": ',
  CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, ', "size.mb": ', CAST(id % 5 AS VARCHAR), '.50}}') AS attributes)
  FROM logs)
SELECT {_SIX} FROM wide WHERE attributes ->> 'k' = '42' AND id % 2 = 0 AND id % 5 = 2 {_NEWEST} LIMIT 100""",
        "search_attr_missing": _search_sql("attributes ->> 'absent' = 'x'"),
        "search_combined": _search_sql(
            f"service = 'svc-2' AND level = 'info' AND {_RANGE} AND message ILIKE '%click%' AND attributes ->> 'k' = '7'"
        ),
        "search_limit1": _search_sql(limit=1),
        "search_after_cursor": _search_sql("(\"timestamp\", id) < (TIMESTAMP '2024-01-15', 5000)"),
        "search_formatted": f"""{_LOGS} SELECT CAST(id AS VARCHAR) AS id,
  concat(strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g'), 'Z') AS "timestamp", level, service, message, attributes
FROM (SELECT * FROM logs {_NEWEST} LIMIT 1000)""",
        "filter_conjunction": f"""{_LOGS} SELECT {_SIX} FROM logs
WHERE service = 'svc-5' AND level = 'warn' AND "timestamp" < {UNTIL_SQL}""",
        "filter_documents": "SELECT doc_id, lang FROM documents WHERE text ILIKE '%the%data%'",
        "page_numbers": f"""{_LOGS} SELECT (row_number() OVER ({_NEWEST}) - 1) // 100 + 1 AS page_no, {_SIX} FROM logs""",
        "page_walk": f"""{_LOGS}, found AS (SELECT *, row_number() OVER ({_NEWEST}) AS place FROM logs WHERE level = 'info')
SELECT (place - 1) // 100 + 1 AS page_no, count(*) AS count, max("timestamp") AS newest, arg_min(id, place) AS newest_id,
  min("timestamp") AS oldest, arg_max(id, place) AS oldest_id FROM found GROUP BY (place - 1) // 100""",
        "page_next_cursor": f"""{_LOGS}, page AS (SELECT * FROM logs WHERE level = 'error' {_NEWEST} LIMIT 50)
SELECT {_SIX}, (SELECT {_TOKEN} FROM page ORDER BY "timestamp", id LIMIT 1) AS next_cursor FROM page""",
        "cursor_encode": f"{_LOGS} SELECT id, {_TOKEN} AS token FROM logs",
        "cursor_decode": f"""{_LOGS} SELECT id AS row_id,
  CASE id % 4 WHEN 0 THEN "timestamp" WHEN 1 THEN date_trunc('millisecond', "timestamp") END AS cursor_timestamp,
  CASE WHEN id % 4 < 2 THEN id END AS cursor_id FROM logs""",
        "agg_1m": _aggregate_sql("1 minute", _WHOLE),
        "agg_5m": _aggregate_sql("5 minutes", _RANGE),
        "agg_1h": _aggregate_sql("1 hour", _RANGE),
        "agg_1d": _aggregate_sql("1 day", _WHOLE),
        "agg_by_service": _aggregate_sql("5 minutes", _WHOLE, "service"),
        "agg_by_level": _aggregate_sql("1 hour", _WHOLE, "level"),
        "agg_filtered": _aggregate_sql("1 hour", f"{_RANGE} AND level = 'error'", "service"),
        "agg_q": _aggregate_sql("1 day", f"{_WHOLE} AND message ILIKE '%PURCHASE%'"),
        "agg_attr": _aggregate_sql("1 day", f"{_WHOLE} AND attributes ->> 'k' = '42'", "level"),
        "agg_empty_range": _aggregate_sql("1 minute", f'"timestamp" >= {SINCE_SQL} AND "timestamp" < {SINCE_SQL}'),
        "agg_formatted": f"""{_LOGS} SELECT concat(strftime({_bucket_sql('1 hour')}, '%Y-%m-%dT%H:%M:%S.%g'), 'Z') AS start,
  level AS "group", count(*) AS count FROM logs WHERE {_WHOLE} GROUP BY 1, 2""",
        "rollup_batch": _MINUTES_SQL,
        "rollup_merge": _MINUTES_SQL,
        "agg_rollup_1m": _aggregate_sql(
            "1 minute",
            f"""level = 'info' AND {_bucket_sql('1 minute')} >= {SINCE_SQL} AND {_bucket_sql('1 minute')} < {UNTIL_SQL}""",
            "service",
        ),
        "agg_auto_unaligned": _aggregate_sql("1 minute", _RANGE, "level"),
        "agg_auto_hours": _aggregate_sql("1 hour", f"{_RANGE} AND service = 'svc-4'"),
        "agg_auto_ineligible": _aggregate_sql("1 minute", f"{_RANGE} AND message ILIKE '%signup%'"),
        "envelope_entries": """SELECT event_id // 100 AS envelope_id, count(*) AS entries,
  CAST(max(event_id % 100) AS INTEGER) AS last_index FROM events WHERE event_id // 100 % 8 = 7 GROUP BY 1""",
        "envelope_refused": """SELECT DISTINCT event_id // 100 AS envelope_id,
  'request body must be an object with a non-empty ''logs'' array' AS reason FROM events WHERE event_id // 100 % 8 < 7""",
        "validate_accepted": f"""{_CHECKED} SELECT envelope_id, index, "timestamp", level, service, message, attributes, attr_k
FROM checked WHERE reason IS NULL""",
        "validate_rejected": f"{_CHECKED} SELECT envelope_id, index, reason FROM checked WHERE reason IS NOT NULL",
        "validate_other_defects": """SELECT event_id // 100 AS envelope_id, CAST(event_id % 100 AS INTEGER) AS index, CASE event_id % 12
  WHEN 0 THEN 'invalid timestamp: ''2024-02-30T10:00:00Z'''
  WHEN 1 THEN 'invalid timestamp: ''2024-01-05T25:00:00Z'''
  WHEN 2 THEN 'message is required'
  WHEN 3 THEN 'message is required'
  WHEN 8 THEN 'service must be a non-empty string'
  WHEN 9 THEN 'message must be a non-empty string'
  ELSE 'attributes must be a flat object with string, number, or boolean values' END AS reason
FROM events WHERE event_id % 12 < 10""",
        "ingest_summary": f"""{_CHECKED} SELECT envelope_id, count(*) FILTER (WHERE reason IS NULL) AS accepted,
  concat('[', coalesce(string_agg(concat('{{"index":', CAST(index AS VARCHAR), ',"reason":"', reason, '"}}'), ','
    ORDER BY index) FILTER (WHERE reason IS NOT NULL), ''), ']') AS rejected,
  CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN 200 ELSE 400 END AS status
FROM checked GROUP BY envelope_id""",
        "event_date_assign": f'{_LOGS} SELECT id, CAST("timestamp" AS DATE) AS event_date FROM logs',
        "id_assign": f"""{_LOGS} SELECT id AS event_id,
  CAST(7 * 8589934592 + row_number() OVER (ORDER BY "timestamp", id) - 1 AS BIGINT) AS id FROM logs""",
        "count_logs": "SELECT count(*) AS count FROM events",
        "table_search": _search_sql(f"{_RANGE} AND attributes ->> 'k' = '42'", 1000),
        "table_recent": _search_sql("service = 'svc-1'", 150),
        "table_page": _page_sql(f"service = 'svc-3' AND \"timestamp\" < {UNTIL_SQL}", 50),
        "table_last_page": f"""{_LOGS}, found AS (SELECT *, row_number() OVER ({_NEWEST}) AS place, count(*) OVER () AS total
  FROM logs WHERE level = 'warn' AND "timestamp" < {UNTIL_SQL})
SELECT {_SIX}, CAST(NULL AS VARCHAR) AS next_cursor FROM found WHERE place > (total - 1) // 1000 * 1000""",
        "table_page_walk": f"""{_LOGS}, found AS (SELECT *, row_number() OVER ({_NEWEST}) AS place, count(*) OVER () AS total,
  {_SNAPSHOT_TOKEN} AS token FROM logs WHERE service = 'svc-6')
SELECT CAST((place - 1) // 1000 + 1 AS INTEGER) AS page_no, CAST(count(*) AS INTEGER) AS count, arg_min(id, place) AS first_id,
  arg_max(id, place) AS last_id, CASE WHEN max(place) < max(total) THEN arg_max(token, place) END AS next_cursor
FROM found GROUP BY (place - 1) // 1000""",
        "table_snapshot": f"{_LOGS} SELECT {_SIX} FROM logs {_NEWEST} LIMIT 100 OFFSET 100",
        "table_search_q": _page_sql("message ILIKE '%p_rch%USER 1_%'", 200),
        "table_search_attrs": _page_sql("attributes ->> 'k' = '42' AND message ILIKE '%click%'", 100),
        "table_vacuumed": f"""{_LOGS} SELECT CAST("timestamp" AS DATE) AS event_date, count(*) AS count,
  CAST(sum(id) AS BIGINT) AS id_sum, CAST(1 AS BIGINT) AS folders FROM logs
WHERE CAST("timestamp" AS DATE) = DATE '{COMPACTED_DAY}' GROUP BY 1""",
        "table_aggregate": _aggregate_sql("1 hour", _RANGE, "level"),
        "compact_day": f"{_LOGS} {_TOTALS_SQL} GROUP BY 1",
        "compact_rollup": _MINUTES_SQL,
        "log_days": "SELECT DISTINCT CAST(ts AS DATE) AS event_date FROM events",
        "expired_days": "SELECT DISTINCT CAST(ts AS DATE) AS event_date FROM events WHERE ts < TIMESTAMP '2024-01-11'",
        "retention": f"{_LOGS} {_TOTALS_SQL} WHERE \"timestamp\" >= TIMESTAMP '2024-01-11' GROUP BY 1",
        "stream_logs": f'{_CHECKED} SELECT "timestamp", level, service, message, attributes FROM checked WHERE reason IS NULL',
        "stream_ids": f"{_CHECKED} SELECT count(*) AS count, count(*) AS ids FROM checked WHERE reason IS NULL",
        "stream_rollup": f"""{_CHECKED} SELECT {_bucket_sql('1 minute')} AS bucket_start, service, level, count(*) AS count
FROM checked WHERE reason IS NULL GROUP BY 1, 2, 3""",
        "stream_rejected": f"""{_CHECKED} SELECT index, reason, count(*) AS count FROM checked
WHERE reason IS NOT NULL GROUP BY 1, 2""",
        "stream_summary": f"""{_CHECKED}, envelopes AS (SELECT envelope_id, count(*) FILTER (WHERE reason IS NULL) AS a,
  count(*) FILTER (WHERE reason IS NOT NULL) AS r FROM checked GROUP BY 1)
SELECT CASE WHEN a > 0 THEN 200 ELSE 400 END AS status, count(*) AS envelopes, CAST(sum(a) AS BIGINT) AS accepted,
  CAST(sum(r) AS BIGINT) AS rejected FROM envelopes GROUP BY 1""",
        "stream_aggregate": _aggregate_sql("1 minute", f"{_RANGE} AND reason IS NULL", "service", "checked", _CHECKED),
        "stream_live_rollup": _MINUTES_SQL,
        "compact_rejected": f"{_VERDICTS} SELECT ingest_date, batch_id, file_path, count(*) AS count FROM verdicts WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
        "compact_summary": f"""{_VERDICTS}, envelopes AS (SELECT ingest_date, file_path, envelope_id,
  count(*) FILTER (WHERE reason IS NULL) AS a, count(*) FILTER (WHERE reason IS NOT NULL) AS r FROM verdicts GROUP BY 1, 2, 3)
SELECT ingest_date, CASE WHEN a > 0 THEN 200 ELSE 400 END AS status, count(*) AS envelopes, CAST(sum(a) AS BIGINT) AS accepted,
  CAST(sum(r) AS BIGINT) AS rejected, count(DISTINCT file_path) AS files FROM envelopes GROUP BY 1, 2""",
        "expired_rejected": f"""{_VERDICTS} SELECT ingest_date, batch_id, file_path, count(*) AS count FROM verdicts
WHERE reason IS NOT NULL AND ingest_date >= DATE '2024-01-02' GROUP BY 1, 2, 3""",
        "stream_batches": f"""{_CHECKED} SELECT count(*) AS count, count(*) AS ids, TRUE AS several, TRUE AS spread
FROM checked WHERE reason IS NULL""",
        "stream_drained": f"{_CHECKED} SELECT level, count(*) AS count FROM checked WHERE reason IS NULL GROUP BY 1",
        "replayed_batch": f"""{_CHECKED} SELECT service, level, count(*) AS count, count(*) AS ids, count(*) AS rollup
FROM checked WHERE reason IS NULL GROUP BY 1, 2""",
        "late_batch": _aggregate_sql("1 minute", f"{_RANGE} AND reason IS NULL", "level", "checked", _CHECKED),
    }
