from datetime import date

import pytest
from conftest import row_set
from pyspark.sql import functions as F

from emberlog.functions.variants import attribute_text_of_json
from emberlog.operators.aggregate import merge_rollup, rollup_batch
from emberlog.operators.identity import INDEX_BITS, assign_ids, dense_index
from emberlog.operators.paging import log_page
from emberlog.operators.search import search_logs
from emberlog.plans import storage
from emberlog.plans.recent_search import search_days
from emberlog.plans.retention import expire_ingested, list_log_days
from emberlog.plans.storage import append_logs, append_rejected, append_rollup, compact_day, compact_rejected, compact_rollup, vacuum_table
from emberlog.sources.files import child_names
from emberlog.sources.tables import read_logs, read_rejected, read_rollup


@pytest.fixture
def batches(make_logs):
    """Three batches over two days, with late rows in the later ones."""

    def batch(offset):
        rows = [
            (f"2026-08-{2 + (i + offset) % 2:02d}T{i % 24:02d}:00:{offset:02d}Z", "info", f"s{i % 3}", f"{offset}-{i}", {"i": i})
            for i in range(30)
        ]
        logs = make_logs(rows).withColumn("id", F.col("id") + F.lit(offset << INDEX_BITS))
        return logs.withColumn("attr_text", attribute_text_of_json("attributes"))

    return [batch(n) for n in range(3)]


@pytest.fixture
def table(spark, batches, tmp_path):
    path = str(tmp_path / "logs")
    for number, batch in enumerate(batches):
        append_logs(batch, path, number)
    return path


def contents(spark, path, upto=None):
    return sorted(r.message for r in read_logs(spark, path, upto).collect())


def test_round_trip(spark, table, batches):
    stored = read_logs(spark, table)
    assert stored.count() == 90
    assert row_set(stored.where("batch_id = 1").select(*batches[1].columns).drop("attr_text")) == row_set(
        batches[1].drop("attr_text")
    )
    assert stored.where("event_date <> to_date(timestamp)").count() == 0


def test_repeated_batch_changes_nothing(spark, table, batches):
    before = contents(spark, table)
    append_logs(batches[1], table, 1)
    assert contents(spark, table) == before


def test_day_pruning(spark, table):
    logs = search_logs(read_logs(spark, table), since="2026-08-03T05:00:00Z")
    plan = logs._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan
    assert all(r.timestamp.day == 3 for r in logs.collect())


def test_named_days(spark, table):
    assert row_set(read_logs(spark, table, days=[date(2026, 8, 3), date(2030, 1, 1)]).drop("attr_text")) == row_set(
        read_logs(spark, table).where("event_date = DATE'2026-08-03'").drop("attr_text")
    )
    assert read_logs(spark, table, days=[date(2030, 1, 1)]).count() == 0
    assert read_logs(spark, table, days=[date(2026, 8, 3)]).inputFiles()[0].count("event_date=2026-08-03") == 1


def test_upto_batch(spark, table):
    assert len(contents(spark, table, 1)) == 60


def test_compact_day(spark, table, batches):
    before = contents(spark, table)
    compact_day(spark, table, date(2026, 8, 2), 1)
    assert contents(spark, table) == before
    vacuum_table(spark, table, 0)
    assert contents(spark, table) == before
    assert sorted(child_names(spark, f"{table}/event_date=2026-08-02")) == ["batch_id=-2", "batch_id=2"]
    assert sorted(child_names(spark, f"{table}/event_date=2026-08-03")) == ["batch_id=0", "batch_id=1", "batch_id=2"]
    # Again with a later batch, and once more with nothing new.
    compact_day(spark, table, date(2026, 8, 2), 2)
    compact_day(spark, table, date(2026, 8, 2), 2)
    assert contents(spark, table) == before
    vacuum_table(spark, table, 0)
    assert child_names(spark, f"{table}/event_date=2026-08-02") == ["batch_id=-3"]
    append_logs(batches[0].withColumn("message", F.lit("late")), table, 3)
    assert contents(spark, table).count("late") == 30


@pytest.mark.parametrize("step", ["_publish", "vacuum_table"])
def test_compaction_that_fails_half_way(spark, table, monkeypatch, step):
    before = contents(spark, table)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(storage, step, fail)
        with pytest.raises(RuntimeError):
            compact_day(spark, table, date(2026, 8, 2), 1)
    assert contents(spark, table) == before
    compact_day(spark, table, date(2026, 8, 2), 1)
    assert contents(spark, table) == before
    vacuum_table(spark, table, 0)
    assert sorted(child_names(spark, f"{table}/event_date=2026-08-02")) == ["batch_id=-2", "batch_id=2"]


def test_rollup_deltas_and_compaction(spark, batches, tmp_path):
    path = str(tmp_path / "rollup")
    for number, batch in enumerate(batches):
        append_rollup(rollup_batch(batch), path, number)
        append_rollup(rollup_batch(batch), path, number)
    total = batches[0].unionByName(batches[1]).unionByName(batches[2])
    expected = row_set(rollup_batch(total))
    assert row_set(merge_rollup(read_rollup(spark, path))) == expected
    compact_rollup(spark, path, 1)
    compact_rollup(spark, path, 1)
    assert row_set(merge_rollup(read_rollup(spark, path))) == expected
    compact_rollup(spark, path, 2)
    stored = read_rollup(spark, path).select("bucket_start", "service", "level", "count")
    assert row_set(stored) == expected and stored.count() == len(expected)


def test_rejected_sink(spark, tmp_path):
    path = str(tmp_path / "rejected")
    rows = spark.createDataFrame([(1, 0, "invalid entry")], "envelope_id long, index int, reason string")
    append_rejected(rows, path, 4)
    append_rejected(rows, path, 4)
    assert [tuple(r) for r in read_rejected(spark, path).collect()] == [(1, 0, "invalid entry", 4)]


@pytest.mark.parametrize("params", [{}, {"service": "s1"}, {"q": "2-17"}, {"q": "none"}, {"until": "2026-08-03T01:00:00Z"}])
@pytest.mark.parametrize("limit", [1, 20, 50])
def test_search_by_days_equals_one_scan(spark, table, params, limit):
    logs = read_logs(spark, table)
    days = [r.event_date for r in list_log_days(spark, table).collect()]
    cursor = None
    for _ in range(3):
        whole, stepped = log_page(logs, limit=limit, cursor=cursor, **params), search_days(logs, days, limit=limit, cursor=cursor, **params)
        assert whole.next_cursor == stepped.next_cursor
        assert whole.rows.collect() == stepped.rows.collect()
        cursor = whole.next_cursor
        if cursor is None:
            break


def test_dense_index(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(1).alias("hot")).repartition(9)
    numbered = dense_index(df, [F.asc("hot"), F.desc("k")], "n")
    assert numbered.where("n <> 4999 - k").count() == 0 and numbered.count() == 5000


def test_ids_are_dense_batch_monotonic_and_repeatable(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("arrival"))
    first = assign_ids(df.repartition(5), 3, [F.asc("arrival")])
    again = assign_ids(df.repartition(8), 3, [F.asc("arrival")])
    assert row_set(first) == row_set(again)
    assert first.where(F.col("id") != F.lit(3 << INDEX_BITS) + F.col("arrival")).count() == 0


def _one_row(make_logs, time):
    return make_logs([(time, "info", "a", "m", {})]).withColumn("attr_text", attribute_text_of_json("attributes"))


def test_compaction_only_moves_forward(spark, make_logs, tmp_path):
    path, day = str(tmp_path / "logs"), date(2026, 8, 2)
    for batch in range(4):
        append_logs(_one_row(make_logs, f"12:0{batch}:00"), path, batch)
    compact_day(spark, path, day, 3)
    compact_day(spark, path, day, 1)
    compact_day(spark, path, day, 3)
    assert read_logs(spark, path).count() == 4
    with pytest.raises(ValueError, match="too late"):
        append_logs(_one_row(make_logs, "12:09:00"), path, 2)
    append_logs(_one_row(make_logs, "12:09:00"), path, 4)
    compact_day(spark, path, day, 4)
    assert read_logs(spark, path).count() == 5


def test_nothing_to_read_before_the_first_batch(spark, tmp_path):
    assert read_logs(spark, str(tmp_path / "none")).collect() == []
    assert read_rollup(spark, str(tmp_path / "none"), days=[date(2026, 8, 2)]).collect() == []


def test_segments_grow_in_tiers(spark, make_logs, tmp_path):
    """A compaction after each batch rewrites the large segment only now and then."""
    path, rollup, day = str(tmp_path / "logs"), str(tmp_path / "rollup"), date(2026, 8, 2)
    rewritten, expected = 0, 0
    for batch in range(7):
        rows = 4000 if batch == 0 else 20
        logs = spark.range(rows).selectExpr(
            f"id + {batch}L * 10000 AS id", "timestamp_micros(1785628800000000 + id * 1000003) AS timestamp", "'info' AS level",
            "concat('s', id % 7) AS service", f"sha2(concat({batch}, '-', id), 256) AS message", "'{}' AS attributes",
        ).withColumn("attr_text", F.create_map().cast("map<string,string>"))
        expected += rows
        append_logs(logs, path, batch)
        append_rollup(rollup_batch(logs), rollup, batch)
        before = {n for n in child_names(spark, f"{path}/event_date=2026-08-02") if n.startswith("batch_id=-")}
        compact_day(spark, path, day, batch)
        compact_rollup(spark, rollup, batch)
        vacuum_table(spark, path, 0)
        after = set(child_names(spark, f"{path}/event_date=2026-08-02"))
        rewritten += "batch_id=-1" in before - after
        assert all(name.startswith("batch_id=-") for name in after)
        assert read_logs(spark, path).count() == expected == read_logs(spark, path).select("id").distinct().count()
        assert merge_rollup(read_rollup(spark, rollup)).agg(F.sum("count")).first()[0] == expected
    assert rewritten == 0 and 2 <= len(after) <= 4
    # Rows from before a segment's end come too late, in whatever segment it is.
    with pytest.raises(ValueError, match="too late"):
        append_logs(logs, path, 3)


def test_rejections_by_day(spark, tmp_path):
    path = str(tmp_path / "rejected")
    for batch in range(3):
        rows = spark.createDataFrame(
            [(e, 0, "invalid entry", f"f{e}", f"2026-08-0{1 + e % 2} 10:00:00") for e in range(4)],
            "envelope_id long, index int, reason string, file_path string, received_at string",
        ).withColumn("received_at", F.to_timestamp("received_at"))
        append_rejected(rows, path, batch)
    expected = row_set(read_rejected(spark, path, origin=True))
    assert len(expected) == 12 and read_rejected(spark, path, [date(2026, 8, 1)]).count() == 6
    compact_rejected(spark, path, date(2026, 8, 1), 1)
    compact_rejected(spark, path, date(2026, 8, 1), 1)
    assert row_set(read_rejected(spark, path, origin=True)) == expected
    vacuum_table(spark, path, 0)
    assert sorted(child_names(spark, f"{path}/ingest_date=2026-08-01")) == ["batch_id=-2", "batch_id=2"]
    compact_rejected(spark, path, date(2026, 8, 1), 2)
    assert row_set(read_rejected(spark, path, origin=True)) == expected
    assert expire_ingested(spark, path, 5, date(2026, 8, 7)).dropped == [date(2026, 8, 1)]
    assert row_set(read_rejected(spark, path, origin=True)) == {r for r in expected if r.ingest_date == date(2026, 8, 2)}
    # Batches of the layout without days are still read.
    spark.createDataFrame([(7, 1, "old")], "envelope_id long, index int, reason string").write.parquet(f"{path}/batch_id=9")
    assert [tuple(r) for r in read_rejected(spark, path).where("batch_id = 9").collect()] == [(7, 1, "old", 9)]
