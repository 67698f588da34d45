"""Keyset pagination: one page, a walk over all pages, and page numbers for a whole result at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.fixed_values import DEFAULT_LIMIT, MAX_LIMIT
from emberlog.functions.cursors import encode_cursor
from emberlog.functions.timestamps import event_date, instant_literal
from emberlog.operators.filters import apply_filters, check_limit
from emberlog.operators.identity import dense_index
from emberlog.operators.search import newest_first
from emberlog.schema import LOG_COLUMNS


@dataclass(frozen=True)
class LogPage:
    rows: DataFrame
    next_cursor: str | None


def with_token(df: DataFrame, snapshot: Mapping[str, int] | None = None) -> DataFrame:
    """Add ``next_cursor``, the token that continues after the row, in the same snapshot if one is given."""
    return df.withColumn("next_cursor", encode_cursor(F.col("timestamp"), F.col("id"), snapshot))


def page_from(found: pa.Table, limit: int, df: DataFrame) -> LogPage:
    """Drop the probe row; its presence alone says that more rows exist."""
    page = found.slice(0, limit)
    token = page.column("next_cursor")[limit - 1].as_py() if found.num_rows > limit else None
    return LogPage(df.sparkSession.createDataFrame(page.select(list(LOG_COLUMNS))), token)


def log_page(df: DataFrame, *, limit: int = DEFAULT_LIMIT, cursor: str | None = None, **filters) -> LogPage:
    """One page and the cursor of the next, ``None`` on the last. At most ``limit + 1`` rows reach the driver."""
    size = check_limit(limit)
    matching = apply_filters(df, cursor=cursor, **filters)
    return page_from(with_token(newest_first(matching, size + 1)).toArrow(), size, df)


def iter_pages(df: DataFrame, *, limit: int = DEFAULT_LIMIT, **filters) -> Iterator[LogPage]:
    """All pages in order. Filters stay fixed over the walk, so nothing is skipped or repeated."""
    cursor = None
    while True:
        page = log_page(df, limit=limit, cursor=cursor, **filters)
        yield page
        cursor = page.next_cursor
        if cursor is None:
            return


def page_bounds(df: DataFrame, page_size: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """``(page_no, count, newest, newest_id, oldest, oldest_id)`` of every page of the walk, from one ranged count.

    Only the sort keys are read and put in order. The keys at either end of a page delimit it, so that pages can be read
    independently, each from the days it is on: ``page_rows`` does that.
    """
    size = check_limit(page_size)
    keys = apply_filters(df, **filters).select("timestamp", "id")
    indexed = dense_index(keys, [F.desc("timestamp"), F.desc("id")], "_index")
    page, place = F.expr(f"_index div {size} + 1").alias("page_no"), F.struct("timestamp", "id")
    bounds = indexed.groupBy(page).agg(F.count("*").alias("count"), F.max(place).alias("newest"), F.min(place).alias("oldest"))
    return bounds.select(
        "page_no", "count",
        F.col("newest.timestamp").alias("newest"), F.col("newest.id").alias("newest_id"),
        F.col("oldest.timestamp").alias("oldest"), F.col("oldest.id").alias("oldest_id"),
    )


def page_rows(df: DataFrame, newest: tuple[datetime, int], oldest: tuple[datetime, int], **filters) -> DataFrame:
    """The rows of a page between two keys, both included, newest first. At most a page, so this sorts little."""
    matching = apply_filters(df, **filters)
    upper, lower = instant_literal(newest[0]), instant_literal(oldest[0])
    place = F.struct("timestamp", "id")
    inside = [
        F.col("timestamp").between(lower, upper),
        place <= F.struct(upper.alias("timestamp"), F.lit(newest[1]).cast("long").alias("id")),
        place >= F.struct(lower.alias("timestamp"), F.lit(oldest[1]).cast("long").alias("id")),
    ]
    if "event_date" in df.columns:
        inside.append(F.col("event_date").between(event_date(lower), event_date(upper)))
    return newest_first(matching.where(reduce(and_, inside)), MAX_LIMIT)


def number_pages(df: DataFrame, page_size: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """Every matching row with its 1-based ``page_no``: the whole page walk as one distributed job."""
    size = check_limit(page_size)
    matching = apply_filters(df, **filters).select(*LOG_COLUMNS)
    indexed = dense_index(matching, [F.desc("timestamp"), F.desc("id")], "_index")
    return indexed.withColumn("page_no", F.expr(f"_index div {size}") + 1).select("page_no", *LOG_COLUMNS)
