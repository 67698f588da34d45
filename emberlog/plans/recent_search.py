"""Search over a day-partitioned table that stops at the first days holding enough rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.fixed_values import DEFAULT_LIMIT
from emberlog.functions.timestamps import event_date
from emberlog.operators.filters import apply_filters, check_limit
from emberlog.operators.paging import LogPage, page_from, with_token
from emberlog.operators.search import newest_first


def search_days(
    logs: DataFrame, days: list[date], *, limit: int = DEFAULT_LIMIT, cursor: str | None = None, **filters
) -> LogPage:
    """The page :func:`log_page` would give, reading the newest of ``days`` first.

    Days are disjoint in time, so once the newest ones hold ``limit + 1`` matches no older day can contribute. The
    number of days per step doubles: a broad query reads one day, a rare match still needs only a logarithmic
    number of jobs and reads no day twice. The steps read the sort key and the filtered columns; whole rows are read
    at the end, only from the row groups that can hold the page.
    """
    size = check_limit(limit)
    matching = apply_filters(logs, cursor=cursor, **filters)
    keys = matching.select(F.unix_micros("timestamp").alias("micros"), "id", "event_date")
    pending, step, missing, oldest = sorted(days, reverse=True), 1, size + 1, None
    while pending and missing > 0:
        chunk, pending, step = pending[:step], pending[step:], step * 2
        between = F.col("event_date").between(F.lit(chunk[-1]), F.lit(chunk[0]))
        newest = keys.where(between).orderBy(F.desc("micros"), F.desc("id")).limit(missing).toArrow()
        if newest.num_rows:
            oldest = newest.column("micros")[newest.num_rows - 1].as_py()
            missing -= newest.num_rows
    if oldest is None:
        rows = matching.limit(0)
    else:
        bound = F.timestamp_micros(F.lit(oldest).cast("long"))
        rows = matching.where((F.col("timestamp") >= bound) & (F.col("event_date") >= event_date(bound)))
    return page_from(with_token(newest_first(rows, size + 1)).toArrow(), size, logs)
