"""Instants: parsing, bucketing and ISO text. Assumes a UTC session (see :mod:`emberlog.session`)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.fixed_values import BUCKETS, QUERY_TIMESTAMP_PATTERN

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MICROSECOND = timedelta(microseconds=1)


def parse_instant(text: Column) -> Column:
    """ISO-8601 text with a zone → timestamp, NULL if it names no real instant.

    Fractions are rounded to microseconds and ``T24:00:00`` is the next midnight; the cast alone truncates the
    first and refuses the second, so both only cost something on rows that need them.
    """
    parsed = F.try_to_timestamp(text)
    long_fraction = (F.length(text) > 27) & text.rlike(r"\.\d{6}[5-9]")
    rounded = F.when(long_fraction, parsed + F.expr("INTERVAL '0.000001' SECOND")).otherwise(parsed)
    midnight = F.regexp_replace(text, r"T24:00:00(\.0+)?(?=[Z+-])", "T00:00:00")
    next_day = F.when(midnight != text, F.try_to_timestamp(midnight) + F.expr("INTERVAL 1 DAY"))
    return F.coalesce(rounded, next_day)


def bucket_start(ts: Column, bucket: str) -> Column:
    """Start of the epoch-aligned tumbling window of the named size."""
    return F.window(ts, BUCKETS[bucket])["start"]


def event_date(ts: Column) -> Column:
    """UTC day of an instant."""
    return F.to_date(ts)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def request_instant(value: str | datetime, name: str) -> datetime:
    """A time bound of a request: UTC ISO text ending in ``Z``, or a datetime (naive means UTC)."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    message = f"{name} must be a valid ISO 8601 timestamp"
    if not isinstance(value, str) or not re.fullmatch(QUERY_TIMESTAMP_PATTERN, value, re.ASCII):
        raise ValueError(message)
    try:
        return datetime.fromisoformat(value)
    except ValueError:
        raise ValueError(message) from None


def micros_of(instant: datetime) -> int:
    return (instant - _EPOCH) // _MICROSECOND


def instant_literal(instant: datetime) -> Column:
    """Timestamp literal independent of any time zone; folds to a constant the scan can push down."""
    return F.timestamp_micros(F.lit(micros_of(instant)).cast("long"))
