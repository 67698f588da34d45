from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.aggregate import rollup_batch
from emberlog.plans.retention import (
    expired_days,
    list_log_days,
    retention_setting,
    run_retention,
    run_table_retention,
)
from emberlog.plans.storage import append_logs, append_rollup
from emberlog.sources.tables import read_logs, read_rollup

TODAY = date(2026, 8, 10)


@pytest.fixture
def table(spark, make_logs, tmp_path):
    def make(*days):
        logs = make_logs([(f"{day}T10:00:00Z", "info", "s", "m", {}) for day in days])
        path = str(tmp_path / "logs")
        append_logs(logs.withColumn("attr_text", F.create_map().cast("map<string,string>")), path, 0)
        append_rollup(rollup_batch(logs), str(tmp_path / "rollup"), 0)
        return path

    return make


def stored_days(spark, path):
    return [str(r.event_date) for r in read_logs(spark, path).select("event_date").distinct().orderBy("event_date").collect()]


def test_drops_all_expired_days(spark, table):
    path = table("2019-01-01", "2019-06-01", "2020-01-01", "2026-08-01")
    result = run_retention(spark, path, 30, TODAY)
    assert result.retention_days == 30
    assert result.dropped == [date(2019, 1, 1), date(2019, 6, 1), date(2020, 1, 1)]
    assert stored_days(spark, path) == ["2026-08-01"]


def test_boundary_day_is_kept(spark, table):
    kept, gone = TODAY - timedelta(days=30), TODAY - timedelta(days=31)
    path = table(kept, gone)
    assert run_retention(spark, path, 30, TODAY).dropped == [gone]
    assert stored_days(spark, path) == [str(kept)]


def test_nothing_expired(spark, table):
    path = table("2026-08-09")
    assert run_retention(spark, path, 30, TODAY).dropped == []
    assert run_retention(spark, path, 0, TODAY).dropped == [date(2026, 8, 9)]


def test_rollup_is_kept_unless_asked_for(spark, table, tmp_path):
    path, rollup = table("2020-01-01", "2026-08-09"), str(tmp_path / "rollup")
    run_retention(spark, path, 30, TODAY, rollup_path=rollup)
    assert read_rollup(spark, rollup).count() == 2
    run_retention(spark, path, 30, TODAY, rollup_path=rollup, include_rollup=True)
    assert read_rollup(spark, rollup).count() == 1


def test_listing_ignores_other_folders(spark, table, tmp_path):
    path = table("2026-08-08", "2026-08-09")
    spark.range(1).write.parquet(f"{path}/event_date=default/batch_id=0")
    spark.range(1).write.parquet(f"{path}/event_date=2020-13-45/batch_id=0")
    rows = list_log_days(spark, path).orderBy("event_date").collect()
    assert [(str(r.event_date), r.files) for r in rows] == [("2026-08-08", 1), ("2026-08-09", 1)]
    assert all(r.bytes > 0 for r in rows)
    assert run_retention(spark, path, 1, TODAY).dropped == [date(2026, 8, 8)]


def test_listing_reads_no_file(spark, table):
    plan = list_log_days(spark, table("2026-08-08"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_expired_days(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2026-07-01', DATE'2026-07-20')) AS event_date")
    assert expired_days(days, 30, TODAY).count() == 10


def test_catalogue_table(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS retention_logs")
    spark.sql("CREATE TABLE retention_logs (id BIGINT, event_date DATE) USING parquet PARTITIONED BY (event_date)"
              f" LOCATION '{tmp_path / 'catalogued'}'")
    spark.sql("INSERT INTO retention_logs VALUES (1, DATE'2020-01-01'), (2, DATE'2026-08-09')")
    spark.sql("MSCK REPAIR TABLE retention_logs")
    result = run_table_retention(spark, "retention_logs", 30, TODAY)
    assert result.dropped == [date(2020, 1, 1)]
    assert [r.id for r in spark.table("retention_logs").collect()] == [2]


def test_setting(monkeypatch):
    monkeypatch.delenv("RETENTION_DAYS", raising=False)
    assert retention_setting() == 30
    monkeypatch.setenv("RETENTION_DAYS", "7")
    assert retention_setting() == 7
    assert retention_setting(90) == 90
    assert retention_setting(0) == 0


@pytest.mark.parametrize("raw", ["abc", "0", "-5", "1.5", "", "inf", "nan"])
def test_invalid_setting(monkeypatch, raw):
    monkeypatch.setenv("RETENTION_DAYS", raw)
    with pytest.raises(ValueError, match=f"^invalid RETENTION_DAYS value: '{raw}'$"):
        retention_setting()
