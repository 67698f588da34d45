import base64
import json

import pytest
from pyspark.sql import functions as F

from emberlog.functions.cursors import decode_cursor, encode_cursor, read_token


def token(body) -> str:
    text = body if isinstance(body, str) else json.dumps(body, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_round_trip(spark):
    df = spark.sql("SELECT TIMESTAMP'2026-08-02 12:00:00.123456' AS timestamp, 42L AS id")
    encoded = df.select(encode_cursor(F.col("timestamp"), F.col("id")).alias("t"))
    assert encoded.first().t == token({"timestamp": "2026-08-02T12:00:00.123456Z", "id": "42"})
    assert encoded.select(decode_cursor(F.col("t")).alias("c")).select("c.*").collect() == df.collect()


@pytest.mark.parametrize("stamp", ["2026-08-02T12:00:00.000Z", "2026-08-02T12:00:00Z", "2026-08-02T12:00Z"])
def test_other_resolutions(spark, stamp):
    instant, row_id = read_token(spark, token({"timestamp": stamp, "id": "42"}))
    assert (instant.isoformat(), row_id) == ("2026-08-02T12:00:00+00:00", 42)


def test_lenient_base64(spark):
    plain = token({"timestamp": "2026-08-02T12:00:00.000Z", "id": "4242"})
    padded = plain.replace("-", "+").replace("_", "/") + "=="
    assert read_token(spark, padded) == read_token(spark, plain) == read_token(spark, plain[:9] + "\n" + plain[9:])


@pytest.mark.parametrize(
    "bad",
    [
        "not-base64!!!",
        "",
        "====",
        "éé",
        token("not json"),
        token("[1]"),
        token("null"),
        token({"timestamp": "2026-08-02T12:00:00.000Z"}),
        token({"id": "42"}),
        token({"timestamp": "08/02/2026", "id": "42"}),
        token({"timestamp": "2026-13-02T12:00:00Z", "id": "42"}),
        token({"timestamp": "2026-08-02T12:00:00+01:00", "id": "42"}),
        token({"timestamp": "2026-08-02T12:00:00Z", "id": "abc"}),
        token({"timestamp": "2026-08-02T12:00:00Z", "id": 42}),
        token({"timestamp": 5, "id": "42"}),
        token({"timestamp": "2026-08-02T12:00:00Z", "id": "99999999999999999999"}),
        base64.urlsafe_b64encode(b"\xff\xfe\xfd").decode(),
    ],
)
def test_malformed(spark, bad):
    with pytest.raises(ValueError, match="^invalid cursor$"):
        read_token(spark, bad)


@pytest.mark.parametrize("after", [" junk", ",1", "]", '],["', " {}"])
def test_text_after_the_token_is_refused(spark, after):
    body = '{"timestamp":"2026-08-02T12:00:00.000Z","id":"42"}' + after
    with pytest.raises(ValueError):
        read_token(spark, base64.urlsafe_b64encode(body.encode()).decode().rstrip("="))
