from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from emberlog.session import prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).astimezone(timezone.utc)


@pytest.fixture(scope="session")
def make_logs(spark):
    """Rows ``(time on 2026-08-02 or ISO text, level, service, message, attributes)`` → logs numbered from 1."""

    def make(rows):
        data = [
            (i + 1, t if "T" in t else f"2026-08-02T{t}Z", level, service, message, json.dumps(attributes))
            for i, (t, level, service, message, attributes) in enumerate(rows)
        ]
        df = spark.createDataFrame(
            data, "id long, timestamp string, level string, service string, message string, attributes string"
        )
        return df.withColumn("timestamp", F.to_timestamp("timestamp"))

    return make


@pytest.fixture(scope="session")
def search_seed(make_logs):
    return make_logs(
        [
            ("12:00:00", "info", "payments", "payment completed", {"user_id": "123", "region": "eu-west"}),
            ("12:05:00", "error", "payments", "payment declined", {"user_id": "456", "retries": 3}),
            ("12:10:00", "warn", "checkout", "slow response detected", {"user_id": "123"}),
        ]
    )


@pytest.fixture(scope="session")
def aggregate_seed(make_logs):
    return make_logs(
        [
            ("12:02:00", "info", "payments", "a", {"region": "eu"}),
            ("12:03:00", "error", "payments", "b", {"region": "us"}),
            ("12:07:00", "info", "checkout", "c", {}),
            ("13:15:00", "warn", "checkout", "d", {}),
        ]
    )


def messages(df) -> list[str]:
    return [row.message for row in df.collect()]


def buckets(df) -> list[tuple]:
    """``(HH:MM, group, count)`` in result order."""
    text = F.date_format("bucket_start", "HH:mm")
    return [tuple(row) for row in df.select(text, "group_value", "count").collect()]


def row_set(df) -> set[Row]:
    return set(df.collect())
