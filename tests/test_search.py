import pytest
from conftest import messages, utc
from pyspark.sql import functions as F

from emberlog.operators.filters import apply_filters
from emberlog.operators.paging import iter_pages, log_page, number_pages
from emberlog.operators.search import format_logs, search_logs


@pytest.mark.parametrize(
    "params, expected",
    [
        ({}, 3),
        ({"service": "payments"}, 2),
        ({"service": "  payments "}, 2),
        ({"service": "Payments"}, 0),
        ({"level": "error"}, 1),
        ({"attrs": {"user_id": "123"}}, 2),
        ({"attrs": {"user_id": 123}}, 2),
        ({"attrs": {"retries": "3"}}, 1),
        ({"attrs": {"retries": "3.0"}}, 0),
        ({"attrs": {"nonexistent_key": "abc"}}, 0),
        ({"attrs": {"user_id": "123", "region": "eu-west"}}, 1),
        ({"q": "DECLINED"}, 1),
        ({"q": "randomtext"}, 0),
        ({"q": "pay%ed"}, 2),
        ({"q": "paymen_ d"}, 1),
        ({"q": "pay\\ment d"}, 1),
        ({"q": "\\%"}, 0),
        ({"since": "2026-08-02T12:03:00Z", "until": "2026-08-02T12:11:00.000Z"}, 2),
        ({"since": "2026-08-02T12:05:00Z"}, 2),
        ({"since": "2026-08-02T12:05Z"}, 2),
        ({"until": "2026-08-02T12:05:00Z"}, 1),
        ({"since": utc("2026-08-02T12:05:00+00:00"), "until": utc("2026-08-02T12:05:00+00:00")}, 0),
        ({"service": "payments", "level": "error", "attrs": {"user_id": "456"}}, 1),
    ],
)
def test_filters(search_seed, params, expected):
    assert search_logs(search_seed, **params).count() == expected
    stored = search_seed.withColumn("attr_text", F.from_json("attributes", "map<string,string>"))
    assert search_logs(stored, **params).count() == expected


def test_boolean_attribute(make_logs):
    logs = make_logs([("12:15:00", "info", "cache", "cache hit", {"cached": True})])
    assert search_logs(logs, attrs={"cached": "true"}).count() == 1
    assert search_logs(logs, attrs={"cached": True}).count() == 1
    assert search_logs(logs, attrs={"cached": "false"}).count() == 0


@pytest.mark.parametrize("key", ["a.b", "a b", "a'b", 'a"b', "$", "a\\b", "[0]"])
def test_attribute_key_is_literal(make_logs, key):
    logs = make_logs([("12:00:00", "info", "s", "hit", {key: 1, "a": {"b": 2}}), ("12:00:00", "info", "s", "no", {})])
    assert messages(search_logs(logs, attrs={key: "1"})) == ["hit"]


@pytest.mark.parametrize(
    "raw, text, match",
    [
        ("1.50", "1.5", True),
        ("1.50", "1.50", False),
        ("1e2", "100", True),
        ("1e2", "100.0", False),
        ("1e21", "1000000000000000000000", True),
        ("1e-7", "0.0000001", True),
        ("-0e0", "0", True),
        ("true", "true", True),
        ('"3"', "3", True),
        ("3", "3", True),
        ("null", "null", False),
    ],
)
def test_number_attributes_compare_as_canonical_text(spark, raw, text, match):
    logs = spark.createDataFrame([(f'{{"v":{raw}}}',)], "attributes string")
    assert (apply_filters(logs, attrs={"v": text}).count() == 1) is match


def test_newest_first_with_id_as_tie_break(make_logs):
    logs = make_logs([(t, "info", "s", m, {}) for t, m in (("12:00:00", "1"), ("12:01:00", "2"), ("12:00:00", "3"))])
    assert messages(search_logs(logs)) == ["2", "3", "1"]
    assert messages(search_logs(logs, limit=1)) == ["2"]


def test_output_shape(make_logs):
    logs = make_logs([("2026-08-02T12:00:00.123987Z", "info", "s", "m", {"n": 1, "b": True})])
    row = format_logs(search_logs(logs)).first()
    assert row.asDict() == {
        "id": "1",
        "timestamp": "2026-08-02T12:00:00.123Z",
        "level": "info",
        "service": "s",
        "message": "m",
        "attributes": '{"n": 1, "b": true}',
    }


@pytest.mark.parametrize(
    "params",
    [
        {"level": "critical"},
        {"limit": 0},
        {"limit": 1001},
        {"limit": 1.5},
        {"limit": "abc"},
        {"since": "not-a-date"},
        {"since": "2026-08-02T12:00:00+01:00"},
        {"until": "2026-02-30T12:00:00Z"},
        {"since": "2026-08-02T13:00:00Z", "until": "2026-08-02T12:00:00Z"},
        {"q": "  "},
        {"service": ""},
        {"attrs": {"": "x"}},
        {"cursor": "not-a-cursor"},
    ],
)
def test_invalid_parameters(search_seed, params):
    with pytest.raises(ValueError):
        search_logs(search_seed, **params)


def test_pages(search_seed):
    first = log_page(search_seed, limit=2)
    assert messages(first.rows) == ["slow response detected", "payment declined"]
    second = log_page(search_seed, limit=2, cursor=first.next_cursor)
    assert messages(second.rows) == ["payment completed"]
    assert second.next_cursor is None
    assert log_page(search_seed, limit=3).next_cursor is None


def test_pages_with_ties(make_logs):
    logs = make_logs([("12:00:00", "info", "s", m, {}) for m in ("first", "second", "third")])
    assert [messages(p.rows) for p in iter_pages(logs, limit=1)] == [["third"], ["second"], ["first"]]


def test_pages_within_one_millisecond(make_logs):
    logs = make_logs([(f"2026-08-02T12:00:00.00000{i}Z", "info", "s", str(i), {}) for i in range(7)])
    assert [m for p in iter_pages(logs, limit=2) for m in messages(p.rows)] == list("6543210")


def test_pages_keep_filters(make_logs):
    logs = make_logs([(f"12:{i % 7:02d}:00", ("info", "error")[i % 2], "s", str(i), {}) for i in range(40)])
    walked = [m for p in iter_pages(logs, limit=3, level="error") for m in messages(p.rows)]
    assert walked == messages(search_logs(logs, level="error"))


def test_page_numbers_equal_the_walk(make_logs):
    logs = make_logs([(f"12:{i * 13 % 60:02d}:00", "info", "s", str(i), {}) for i in range(50)]).repartition(7)
    walked = {(n, m) for n, p in enumerate(iter_pages(logs, limit=8), 1) for m in messages(p.rows)}
    assert {(r.page_no, r.message) for r in number_pages(logs, 8).collect()} == walked


def test_page_numbers_with_one_hot_instant(spark, make_logs):
    logs = make_logs([("12:00:00", "info", "s", str(i), {}) for i in range(300)]).repartition(5)
    numbered = number_pages(logs, 100).orderBy(F.desc("id")).collect()
    assert [r.page_no for r in numbered] == [1] * 100 + [2] * 100 + [3] * 100


def test_top_k_plan(search_seed):
    plan = search_logs(search_seed, level="info")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
