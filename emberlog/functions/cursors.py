"""Opaque page cursors: base64url of ``{"timestamp":…,"id":"…"}``.

The timestamp carries microseconds, the full resolution of the column, so rows within one millisecond are never
skipped at a page edge. Tokens with milliseconds are read as well.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlog.fixed_values import CURSOR_ID_PATTERN, ERROR_CURSOR, QUERY_TIMESTAMP_PATTERN
from emberlog.functions.text import matches
from emberlog.functions.timestamps import iso_micros
from emberlog.functions.variants import as_string, field, is_string


def encode_cursor(ts: Column, row_id: Column, snapshot: Mapping[str, int] | None = None) -> Column:
    """The token of a row; ``snapshot``, numbers that say what the walk reads, is carried along in it."""
    carried = [F.lit(number).cast("long").alias(name) for name, number in (snapshot or {}).items()]
    body = F.to_json(F.struct(iso_micros(ts).alias("timestamp"), row_id.cast("string").alias("id"), *carried))
    token = F.base64(F.encode(body, "UTF-8"))
    # Long ones come in lines.
    return F.rtrim(F.translate(token, "+/\r\n", "-_"), F.lit("="))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


#: The text of a token as :func:`encode_cursor` writes it, which needs no JSON parser.
_WRITTEN = r'^\{"timestamp":"([^"\\]*)","id":"([^"\\]*)"(?:,"(?:batch|generation)":-?\d+)*\}\z'


def _members(text: Column) -> Column:
    """The two members of a token's text, if it is one JSON object with nothing behind it and both are strings."""
    # The parser ignores what follows a complete value, so the token must be the whole first of two elements.
    end = uuid4().hex

    def of(pair: Column) -> Column:
        whole = F.try_variant_get(pair, "$[1]", "string").eqNullSafe(F.lit(end)) & F.try_variant_get(pair, "$[2]", "variant").isNull()
        body = F.try_variant_get(pair, "$[0]", "variant")

        def member(name: str) -> Column:
            return _with(field(body, name), lambda value: F.when(is_string(value), as_string(value)))

        return F.when(whole, F.struct(member("timestamp").alias("ts"), member("id").alias("id")))

    return _with(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{end}"]'))), of)


def _checked(found: Column) -> Column:
    ts, row_id = found["ts"], found["id"]
    with_seconds = F.regexp_replace(ts, r"T(\d{2}:\d{2})Z$", "T$1:00Z")
    parsed = F.struct(F.try_to_timestamp(with_seconds).alias("timestamp"), row_id.try_cast("long").alias("id"))
    valid = _with(parsed, lambda p: F.when(p["timestamp"].isNotNull() & p["id"].isNotNull(), p))
    return F.when(matches(ts, QUERY_TIMESTAMP_PATTERN) & matches(row_id, CURSOR_ID_PATTERN), valid)


def decode_cursor(token: Column) -> Column:
    """``struct<timestamp timestamp, id bigint>``, or NULL for anything that is not a valid token. Further members of a
    token are ignored."""
    # Both base64 alphabets are read, padding and foreign characters ignored.
    symbols = F.regexp_replace(F.translate(F.substring_index(token, "=", 1), "-_", "+/"), "[^A-Za-z0-9+/]", "")

    def binary(plain: Column) -> Column:
        padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
        return F.try_to_binary(padded, F.lit("base64"))

    def members(text: Column) -> Column:
        written = F.struct(F.regexp_extract(text, _WRITTEN, 1).alias("ts"), F.regexp_extract(text, _WRITTEN, 2).alias("id"))
        return F.when(text.rlike(_WRITTEN), written).otherwise(_members(text))

    text = F.try_validate_utf8(_with(symbols, binary).cast("string"))
    return _with(_with(text, members), _checked)


def read_snapshot(token: str, names: Sequence[str]) -> dict[str, int] | None:
    """The numbers that :func:`encode_cursor` put into a token; ``None`` if it lacks one."""
    symbols = re.sub("[^A-Za-z0-9_-]", "", token.partition("=")[0].translate(str.maketrans("+/", "-_")))
    try:
        body = json.loads(base64.urlsafe_b64decode(symbols + "=" * (-len(symbols) % 4)))
    except ValueError:
        return None
    found = {name: body.get(name) for name in names} if isinstance(body, dict) else {}
    return found if found and all(type(number) is int for number in found.values()) else None


def read_token(spark: SparkSession, token: str) -> tuple[datetime, int]:
    """Decode one token of a request. A one-row local relation folds on the driver; no job is run."""
    row = (
        spark.createDataFrame(pa.table({"token": pa.array([token], pa.string())}))
        .select(decode_cursor(F.col("token")).alias("c"))
        .select(F.unix_micros("c.timestamp").alias("micros"), "c.id")
        .first()
    )
    if row is None or row.micros is None:
        raise ValueError(ERROR_CURSOR)
    return datetime.fromtimestamp(row.micros // 1_000_000, timezone.utc).replace(
        microsecond=row.micros % 1_000_000
    ), row.id
