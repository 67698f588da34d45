import json

import pytest
from pyspark.sql import functions as F

from emberlog.functions.variants import attribute_text_of_json
from emberlog.operators.validate import check_entries, ingest_summary, validate_entries
from emberlog.sources.envelopes import explode_envelopes

BASE = {"timestamp": "2026-08-02T12:00:00Z", "level": "info", "service": "payments", "message": "payment completed"}
FLAT = "attributes must be a flat object with string, number, or boolean values"
MISSING = object()


def now():
    return F.timestamp_seconds(F.lit(1785715200))  # 2026-08-03T00:00:00Z


def envelopes(spark, *documents):
    return spark.createDataFrame(list(enumerate(documents)), "envelope_id long, value string")


def verdicts(spark, *entries):
    """Reason per raw JSON entry, all in one envelope."""
    frame, _ = explode_envelopes(envelopes(spark, '{"logs":[' + ",".join(entries) + "]}"))
    return [r.reason for r in check_entries(frame, now()).orderBy("index").collect()]


def changed(**fields):
    entry = {k: v for k, v in {**BASE, **fields}.items() if v is not MISSING}
    return json.dumps(entry, ensure_ascii=False)


@pytest.mark.parametrize("document, entries", [('{"logs":[1]}', 1), ('{"logs":[1,"a",null],"x":2} ', 3), ('{"logs":[null]}', 1)])
def test_good_envelopes(spark, document, entries):
    found, refused = explode_envelopes(envelopes(spark, document))
    assert (found.count(), refused.count()) == (entries, 0)


@pytest.mark.parametrize(
    "document",
    [
        "",
        "nope",
        "5",
        "null",
        '"text"',
        "[]",
        '[{"logs":[1]}]',
        "{}",
        '{"logs":[]}',
        '{"logs":null}',
        '{"logs":{"a":1}}',
        '{"logs":"text"}',
        '{"log":[1]}',
        '{"logs":[1]} x',
        '{"logs":[1]}{"logs":[1]}',
        '{"logs":[1]},{"logs":[1]}',
        '{"logs":[1]',
        "{'logs':[1]}",
        '{"logs":[NaN]}',
    ],
)
def test_refused_envelopes(spark, document):
    entries, refused = explode_envelopes(envelopes(spark, document))
    assert entries.count() == 0
    assert [tuple(r) for r in refused.collect()] == [
        (0, "request body must be an object with a non-empty 'logs' array")
    ]


@pytest.mark.parametrize(
    "entry, reason",
    [
        (changed(), None),
        ("null", "invalid entry"),
        ("5", "invalid entry"),
        ('"text"', "invalid entry"),
        ("[]", "invalid entry"),
        ('[{"timestamp":"2026-08-02T12:00:00Z"}]', "invalid entry"),
        ("{}", "timestamp is required"),
        (changed(timestamp=MISSING), "timestamp is required"),
        (changed(timestamp=None), "timestamp is required"),
        (changed(timestamp=5), "timestamp is required"),
        (changed(timestamp={"a": 1}), "timestamp is required"),
        (changed(timestamp="not-a-date"), "invalid timestamp: 'not-a-date'"),
        (changed(timestamp=""), "invalid timestamp: ''"),
        (changed(timestamp="2026-08-02T12:00Z"), "invalid timestamp: '2026-08-02T12:00Z'"),
        (changed(timestamp="2026-08-02T12:00:00z"), "invalid timestamp: '2026-08-02T12:00:00z'"),
        (changed(timestamp="2026-08-02T12:00:00"), "invalid timestamp: '2026-08-02T12:00:00'"),
        (changed(timestamp="2026-08-02 12:00:00Z"), "invalid timestamp: '2026-08-02 12:00:00Z'"),
        (changed(timestamp="2026-08-02T12:00:00Z\n"), "invalid timestamp: '2026-08-02T12:00:00Z\n'"),
        (changed(timestamp="2026-13-02T12:00:00Z"), "invalid timestamp: '2026-13-02T12:00:00Z'"),
        (changed(timestamp="2026-08-02T12:61:00Z"), "invalid timestamp: '2026-08-02T12:61:00Z'"),
        (changed(timestamp="2026-08-02T24:00:00Z"), None),
        (changed(timestamp="2026-08-02T24:00:01Z"), "invalid timestamp: '2026-08-02T24:00:01Z'"),
        (changed(timestamp="2026-08-02T12:00:00.123456789+05:30"), None),
        (changed(timestamp="2026-08-03T00:05:00Z"), None),
        (changed(timestamp="2026-08-03T00:02:00Z"), None),
        (
            changed(timestamp="2026-08-03T00:05:00.001Z"),
            "timestamp is too far in the future: '2026-08-03T00:05:00.001Z'",
        ),
        (changed(timestamp="2026-08-03T00:10:00Z"), "timestamp is too far in the future: '2026-08-03T00:10:00Z'"),
        (changed(timestamp="2026-08-03T00:10:00+05:30"), None),
        (changed(level="critical"), "invalid level: 'critical'"),
        (changed(level="INFO"), "invalid level: 'INFO'"),
        (changed(level=""), "invalid level: ''"),
        (changed(level=MISSING), "invalid level: 'undefined'"),
        (changed(level=None), "invalid level: 'null'"),
        (changed(level=5), "invalid level: '5'"),
        (changed(level=1.5), "invalid level: '1.5'"),
        (changed(level=True), "invalid level: 'true'"),
        (changed(level={"a": 1}), "invalid level: '[object Object]'"),
        (changed(level=["info", 2, None, [3, 4], {}]), "invalid level: 'info,2,,3,4,[object Object]'"),
        (changed(level=[]), "invalid level: ''"),
        (changed(service=MISSING), "service is required"),
        (changed(service=None), "service is required"),
        (changed(service=5), "service is required"),
        (changed(service=""), "service must be a non-empty string"),
        (changed(service="   "), "service must be a non-empty string"),
        (changed(service="\t 　﻿\n"), "service must be a non-empty string"),
        (changed(service="x" * 100), None),
        (changed(service=" " + "x" * 100 + "\n"), None),
        (changed(service="x" * 101), "service must be a non-empty string"),
        (changed(service="\U0001f600" * 50), None),
        (changed(service="\U0001f600" * 51), "service must be a non-empty string"),
        (changed(service="é" * 100), None),
        (changed(message=MISSING), "message is required"),
        (changed(message=False), "message is required"),
        (changed(message=""), "message must be a non-empty string"),
        (changed(message="x" * 1000), None),
        (changed(message="x" * 1001), "message must be a non-empty string"),
        (changed(attributes={}), None),
        (changed(attributes={"a": "x", "b": 1, "c": True, "d": 1.5}), None),
        (changed(attributes=None), FLAT),
        (changed(attributes=[]), FLAT),
        (changed(attributes="x"), FLAT),
        (changed(attributes={"a": {"b": 1}}), FLAT),
        (changed(attributes={"a": [1]}), FLAT),
        (changed(attributes={"a": None}), FLAT),
        (changed(attributes={"ok": 1, "a": {}}), FLAT),
        (changed(attributes={"x: OBJECT<": 1, "VOID": "y"}), None),
        (changed(extra={"a": [1]}), None),
        # The first failing rule names the reason.
        (changed(timestamp=5, level="bad", service=""), "timestamp is required"),
        (changed(level="bad", service="", message=""), "invalid level: 'bad'"),
        (changed(service="", message="", attributes=None), "service must be a non-empty string"),
        (changed(message="", attributes=None), "message must be a non-empty string"),
    ],
)
def test_reasons(spark, entry, reason):
    assert verdicts(spark, entry) == [reason]


def test_duplicate_keys_keep_the_last(spark):
    entry = '{"level":"bad",' + changed()[1:-1] + ',"attributes":{"a":1,"a":2}}'
    accepted, rejected = validate_entries(explode_envelopes(envelopes(spark, f'{{"logs":[{entry}]}}'))[0], now())
    assert rejected.count() == 0
    assert accepted.first().attr_text == {"a": "2"}


def test_mixed_batch_keeps_index_and_order(spark):
    document = '{"logs":[' + ",".join([changed(), changed(level="bad"), changed(service=""), changed()]) + "]}"
    accepted, rejected = validate_entries(explode_envelopes(envelopes(spark, document, document))[0], now())
    assert [r["index"] for r in accepted.orderBy("envelope_id", "index").collect()] == [0, 3, 0, 3]
    assert [tuple(r) for r in rejected.where("envelope_id = 1").orderBy("index").collect()] == [
        (1, 1, "invalid level: 'bad'"),
        (1, 2, "service must be a non-empty string"),
    ]


def test_normal_form(spark):
    entry = changed(service=" \tpayments ", message="\n a  b ", unknown=1, timestamp="2026-08-02T17:30:00.1+05:30")
    accepted, _ = validate_entries(explode_envelopes(envelopes(spark, f'{{"logs":[{entry}]}}'))[0], now())
    row = accepted.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()
    assert row.asDict() == {
        "envelope_id": 0,
        "index": 0,
        "timestamp": "2026-08-02 12:00:00.100000",
        "level": "info",
        "service": "payments",
        "message": "a  b",
        "attributes": "{}",
        "attr_text": {},
    }


@pytest.mark.parametrize(
    "text, instant",
    [
        ("2026-08-02T12:00:00.1234565Z", "2026-08-02 12:00:00.123457"),
        ("2026-08-02T12:00:00.1234564Z", "2026-08-02 12:00:00.123456"),
        ("2026-08-02T12:00:00.9999999Z", "2026-08-02 12:00:01.000000"),
        ("2026-08-01T24:00:00Z", "2026-08-02 00:00:00.000000"),
        ("2026-08-01T24:00:00.000-01:00", "2026-08-02 01:00:00.000000"),
        ("2024-02-29T00:00:00Z", "2024-02-29 00:00:00.000000"),
        ("1969-12-31T23:59:59.5Z", "1969-12-31 23:59:59.500000"),
    ],
)
def test_instants(spark, text, instant):
    frame, _ = explode_envelopes(envelopes(spark, f'{{"logs":[{changed(timestamp=text)}]}}'))
    checked = check_entries(frame, now()).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    assert checked.first().t == instant


@pytest.mark.parametrize(
    "raw, text",
    [
        ("1.50", "1.5"),
        ("1e2", "100"),
        ("1.25e2", "125"),
        ("1.25e1", "12.5"),
        ("1e7", "10000000"),
        ("1.5e7", "15000000"),
        ("123456789.125e0", "123456789.125"),
        ("1e21", "1000000000000000000000"),
        ("-1e21", "-1000000000000000000000"),
        ("1.5e300", "15" + "0" * 299),
        ("1e-7", "0.0000001"),
        ("-1.25e-7", "-0.000000125"),
        ("1e-3", "0.001"),
        ("-0.0", "0"),
        ("-0e0", "0"),
        ("0", "0"),
        ("12345678901234567890", "12345678901234567890"),
        ("true", "true"),
        ('"3.0"', "3.0"),
        ('" x "', " x "),
    ],
)
def test_attribute_text(spark, raw, text):
    df = spark.createDataFrame([(f'{{"v":{raw}}}',)], "a string")
    assert df.select(attribute_text_of_json("a").alias("m")).first().m == {"v": text}


def test_summary(spark):
    documents = [
        '{"logs":[' + ",".join([changed(level="x"), changed(), "7"]) + "]}",
        '{"logs":[' + changed(level="x") + "]}",
        '{"logs":[' + changed() + "]}",
    ]
    entries, _ = explode_envelopes(envelopes(spark, *documents))
    rows = ingest_summary(*validate_entries(entries, now())).orderBy("envelope_id").collect()
    assert [(r.accepted, [tuple(i) for i in r.rejected], r.status) for r in rows] == [
        (1, [(0, "invalid level: 'x'"), (2, "invalid entry")], 200),
        (0, [(0, "invalid level: 'x'")], 400),
        (1, [], 200),
    ]


def test_filter_on_the_verdict_stays_above_it(spark):
    accepted, _ = validate_entries(explode_envelopes(envelopes(spark, "{}"))[0])
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("timestamp is required") == 1


def test_levels_nested_in_any_number_of_arrays_are_shown(spark):
    deep = ["a[", 2.5, None, [], [[], 1e21], {"b": [1]}]
    for _ in range(10):
        deep = [deep, [None]]
    assert verdicts(spark, changed(level=[[[[1, [2, None]]]]]), changed(level=deep), changed(level=[[]]), changed(level=[])) == [
        "invalid level: '1,2,'", f"invalid level: 'a[,2.5,,,,1e+21,[object Object]{',' * 10}'", "invalid level: ''", "invalid level: ''"
    ]
