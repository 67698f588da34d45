"""Request parameters and the predicates they stand for. All filters are optional and ANDed."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions.cursors import read_token
from emberlog.functions.text import contains_pattern
from emberlog.functions.timestamps import event_date, instant_literal, request_instant
from emberlog.functions.variants import attribute_equals


@dataclass(frozen=True)
class Filters:
    """Checked filter values, ready to be turned into predicates."""

    service: str | None = None
    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    q: str | None = None
    attrs: Mapping[str, str] = field(default_factory=dict)


def _text(value: str | None, name: str) -> str | None:
    if value is None:
        return None
    trimmed = value.strip(fixed.WHITE_SPACE) if isinstance(value, str) else ""
    if not trimmed:
        raise ValueError(f"{name} must be a non-empty string")
    return trimmed


def _attribute_text(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (float, Decimal)):
        # Stored numbers are canonical: 2.0 is kept as 2.
        if not math.isfinite(value):
            raise ValueError("attribute values must be finite")
        return format(Decimal(str(value)).normalize() + 0, "f")
    return str(value)


def check_filters(
    *,
    service: str | None = None,
    level: str | None = None,
    since: str | datetime | None = None,
    until: str | datetime | None = None,
    q: str | None = None,
    attrs: Mapping[str, object] | None = None,
) -> Filters:
    """Guard clauses shared by every query; raises ``ValueError`` on a bad parameter."""
    if level is not None and level not in fixed.LEVELS:
        raise ValueError(f"level must be one of {', '.join(fixed.LEVELS)}")
    lower = None if since is None else request_instant(since, "since")
    upper = None if until is None else request_instant(until, "until")
    if lower is not None and upper is not None and upper < lower:
        raise ValueError(fixed.ERROR_RANGE)
    if any(key == "" for key in attrs or {}):
        raise ValueError(fixed.ERROR_ATTRIBUTE_KEY)
    return Filters(
        service=_text(service, "service"),
        level=level,
        since=lower,
        until=upper,
        q=_text(q, "q"),
        attrs={key: _attribute_text(value) for key, value in (attrs or {}).items()},
    )


def check_limit(limit: int | str) -> int:
    try:
        number = float(limit)
    except (TypeError, ValueError):
        raise ValueError("limit must be an integer") from None
    if not number.is_integer() or not fixed.MIN_LIMIT <= number <= fixed.MAX_LIMIT:
        raise ValueError(f"limit must be an integer from {fixed.MIN_LIMIT} to {fixed.MAX_LIMIT}")
    return int(number)


def time_predicates(df: DataFrame, since: datetime | None, until: datetime | None) -> list[Column]:
    """Half-open range on the instant plus, on a day-partitioned table, the days it implies.

    A range on ``timestamp`` alone prunes row groups but no directories.
    """
    by_day = "event_date" in df.columns
    out: list[Column] = []
    if since is not None:
        bound = instant_literal(since)
        out.append(F.col("timestamp") >= bound)
        if by_day:
            out.append(F.col("event_date") >= event_date(bound))
    if until is not None:
        bound = instant_literal(until)
        out.append(F.col("timestamp") < bound)
        if by_day:
            out.append(F.col("event_date") <= event_date(bound))
    return out


def attribute_predicate(df: DataFrame, key: str, value: str) -> Column:
    """Attribute equality as text; a row without the key does not match."""
    if "attr_text" in df.columns:
        return F.try_element_at(F.col("attr_text"), F.lit(key)) == value
    return attribute_equals(F.col("attributes"), key, value)


def predicates(df: DataFrame, filters: Filters) -> list[Column]:
    out = time_predicates(df, filters.since, filters.until)
    if filters.service is not None:
        out.append(F.col("service") == filters.service)
    if filters.level is not None:
        out.append(F.col("level") == filters.level)
    if filters.q is not None:
        out.append(contains_pattern(F.col("message"), filters.q))
    out.extend(attribute_predicate(df, key, value) for key, value in filters.attrs.items())
    return out


def keyset_predicate(df: DataFrame, cursor: str | tuple[datetime, int]) -> list[Column]:
    """Rows strictly older than the cursor in (timestamp, id) order.

    The redundant bound on ``timestamp`` (and day) is what row-group and directory pruning can use.
    """
    instant, row_id = read_token(df.sparkSession, cursor) if isinstance(cursor, str) else cursor
    bound = instant_literal(instant)
    ts = F.col("timestamp")
    out = [ts <= bound, (ts < bound) | ((ts == bound) & (F.col("id") < F.lit(row_id)))]
    if "event_date" in df.columns:
        out.append(F.col("event_date") <= event_date(bound))
    return out


def apply_filters(df: DataFrame, *, cursor: str | tuple[datetime, int] | None = None, **params) -> DataFrame:
    """``df`` restricted by any of ``service level since until q attrs cursor``; none keeps the whole table."""
    conditions = predicates(df, check_filters(**params))
    if cursor is not None:
        conditions += keyset_predicate(df, cursor)
    return df.where(reduce(and_, conditions)) if conditions else df
