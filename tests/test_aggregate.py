import random
from datetime import date, datetime, timedelta, timezone

import pytest
from conftest import buckets, row_set
from pyspark.sql import functions as F

from emberlog.operators.aggregate import (
    aggregate_logs,
    aggregate_rollup,
    count_logs,
    format_buckets,
    merge_rollup,
    rollup_batch,
)
from emberlog.plans.auto_aggregate import aggregate_auto, can_use_rollup, named_days, whole_minutes


def at(time: str) -> str:
    return f"2026-08-02T{time}:00Z"


def test_five_minutes(aggregate_seed):
    assert buckets(aggregate_logs(aggregate_seed, at("12:00"), at("13:00"), "5m")) == [
        ("12:00", None, 2),
        ("12:05", None, 1),
    ]


def test_one_minute(aggregate_seed):
    assert buckets(aggregate_logs(aggregate_seed, at("12:02"), at("12:08"), "1m")) == [
        ("12:02", None, 1),
        ("12:03", None, 1),
        ("12:07", None, 1),
    ]


def test_one_hour(aggregate_seed):
    assert buckets(aggregate_logs(aggregate_seed, at("12:00"), at("14:00"), "1h")) == [
        ("12:00", None, 3),
        ("13:00", None, 1),
    ]


def test_one_day(aggregate_seed):
    out = aggregate_logs(aggregate_seed, "2026-08-02T00:00:00Z", "2026-08-03T00:00:00Z", "1d")
    assert buckets(out) == [("00:00", None, 4)]


@pytest.mark.parametrize(
    "group_by, expected",
    [
        ("service", [("12:00", "payments", 2), ("12:05", "checkout", 1)]),
        ("level", [("12:00", "error", 1), ("12:00", "info", 1), ("12:05", "info", 1)]),
    ],
)
def test_grouped(aggregate_seed, group_by, expected):
    assert buckets(aggregate_logs(aggregate_seed, at("12:00"), at("13:00"), "5m", group_by=group_by)) == expected


@pytest.mark.parametrize(
    "params, total",
    [
        ({"service": "checkout"}, 2),
        ({"level": "error"}, 1),
        ({"attrs": {"region": "eu"}}, 1),
        ({"attrs": {"region": "eu", "zone": "1"}}, 0),
        ({"q": "A"}, 1),
        ({"service": "checkout", "level": "warn"}, 1),
    ],
)
def test_filtered(aggregate_seed, params, total):
    out = aggregate_logs(aggregate_seed, at("12:00"), at("14:00"), "1h", **params)
    assert sum(n for _, _, n in buckets(out)) == total


def test_range_is_half_open(make_logs):
    logs = make_logs([(t, "info", "s", "m", {}) for t in ("12:00:00", "12:30:00", "13:00:00")])
    assert buckets(aggregate_logs(logs, at("12:00"), at("13:00"), "1h")) == [("12:00", None, 2)]
    assert buckets(aggregate_logs(logs, at("12:00"), at("12:00"), "1h")) == []


def test_buckets_are_aligned_to_the_epoch_and_sparse(make_logs):
    logs = make_logs([(t, "info", "s", "m", {}) for t in ("12:04:00", "12:02:00", "12:15:00", "12:19:59")])
    assert buckets(aggregate_logs(logs, at("12:03"), at("12:08"), "5m")) == [("12:00", None, 1)]
    assert buckets(aggregate_logs(logs, at("12:00"), at("13:00"), "5m")) == [("12:00", None, 2), ("12:15", None, 2)]


def test_before_the_epoch(make_logs):
    logs = make_logs([("1969-12-31T23:58:30Z", "info", "s", "m", {})])
    out = aggregate_logs(logs, "1969-12-31T00:00:00Z", "1970-01-01T00:00:00Z", "5m")
    assert buckets(out) == [("23:55", None, 1)]


def test_output_shape(aggregate_seed):
    out = format_buckets(aggregate_logs(aggregate_seed, at("12:00"), at("12:05"), "5m"))
    assert [tuple(r) for r in out.collect()] == [("2026-08-02T12:00:00.000Z", None, 2)]
    assert out.columns == ["start", "group", "count"]


@pytest.mark.parametrize(
    "args, params",
    [
        ((None, at("12:00"), "1m"), {}),
        ((at("12:00"), None, "1m"), {}),
        ((at("13:00"), at("12:00"), "1m"), {}),
        ((at("12:00"), "tomorrow", "1m"), {}),
        ((at("12:00"), at("13:00"), "2m"), {}),
        ((at("12:00"), at("13:00"), None), {}),
        ((at("12:00"), at("13:00"), "1m"), {"group_by": "message"}),
        ((at("12:00"), at("13:00"), "1m"), {"level": "fatal"}),
        ((at("12:00"), at("13:00"), "1m"), {"attrs": {"": "x"}}),
        ((at("12:00"), at("13:00"), "1m"), {"q": ""}),
    ],
)
def test_invalid_parameters(aggregate_seed, args, params):
    with pytest.raises(ValueError):
        aggregate_logs(aggregate_seed, *args, **params)


def test_count(aggregate_seed):
    assert count_logs(aggregate_seed).first()[0] == 4


def test_rollup_batch_and_merge(aggregate_seed):
    once = rollup_batch(aggregate_seed)
    assert once.count() == 4
    twice = merge_rollup(once.unionByName(once))
    assert {r["count"] for r in twice.collect()} == {2} and twice.count() == 4


def test_rollup_query(aggregate_seed):
    rollup = rollup_batch(aggregate_seed)
    raw = aggregate_logs(aggregate_seed, at("12:00"), at("14:00"), "1m", group_by="service", level="info")
    out = aggregate_rollup(rollup, at("12:00"), at("14:00"), group_by="service", level="info")
    assert buckets(out) == buckets(raw)


def test_rollup_query_counts_minutes_by_their_start(make_logs):
    rollup = rollup_batch(make_logs([("12:00:50", "info", "s", "m", {}), ("12:01:50", "info", "s", "m", {})]))
    out = aggregate_rollup(rollup, "2026-08-02T12:00:30Z", "2026-08-02T12:01:30Z")
    assert buckets(out) == [("12:01", None, 1)]


def test_eligibility():
    assert can_use_rollup("1m") and can_use_rollup("5m", any_bucket=True)
    assert not can_use_rollup("5m")
    assert not can_use_rollup("1m", q="x")
    assert not can_use_rollup("1m", attrs={"a": "b"})


def test_whole_minutes():
    t = datetime(2026, 8, 2, 12, 0, 30, tzinfo=timezone.utc)
    assert whole_minutes(t, t + timedelta(minutes=2)) == (t.replace(minute=1, second=0), t.replace(minute=2, second=0))
    start, end = whole_minutes(t, t + timedelta(seconds=20))
    assert start > end


def test_named_days():
    assert named_days(at("12:00"), "2026-08-03T00:00:00Z") == [date(2026, 8, 2), date(2026, 8, 3)]
    assert len(named_days(at("12:00"), "2027-08-03T00:00:00Z")) == 367
    assert named_days(at("12:00"), "2026-08-01T00:00:00Z") is None
    assert named_days(None, at("12:00")) is None


@pytest.mark.parametrize("seed", range(6))
def test_auto_equals_raw_on_random_ranges(make_logs, seed):
    rng = random.Random(seed)
    rows = [
        (
            f"2026-08-02T12:{rng.randrange(6):02d}:{rng.randrange(60):02d}.{rng.randrange(10**6):06d}Z",
            rng.choice(["info", "warn"]),
            rng.choice("ab"),
            "m",
            {},
        )
        for _ in range(200)
    ]
    logs = make_logs(rows).cache()
    rollup = rollup_batch(logs)
    base = datetime(2026, 8, 2, 12, tzinfo=timezone.utc)
    since, until = sorted(base + timedelta(seconds=rng.choice([60 * rng.randrange(7), rng.random() * 400])) for _ in "ab")
    params = {"group_by": rng.choice([None, "service", "level"]), "service": rng.choice([None, "a"])}
    for bucket in ("1m", "5m", "1h"):
        raw = aggregate_logs(logs, since, until, bucket, **params)
        assert row_set(aggregate_auto(logs, rollup, since, until, bucket, any_bucket=True, **params)) == row_set(raw)
    logs.unpersist()


def test_auto_reads_rows_only_at_the_edges(make_logs):
    """With an empty rollup only the two partial minutes are counted."""
    logs = make_logs([(f"12:{m:02d}:45", "info", "s", "m", {}) for m in range(5)])
    rollup = rollup_batch(logs.where(F.lit(False)))
    out = aggregate_auto(logs, rollup, "2026-08-02T12:00:30Z", "2026-08-02T12:04:50Z", "1m")
    assert buckets(out) == [("12:00", None, 1), ("12:04", None, 1)]


def test_partial_aggregation_before_the_shuffle(aggregate_seed):
    plan = aggregate_logs(aggregate_seed, at("12:00"), at("13:00"), "5m")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
