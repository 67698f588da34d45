"""Search over an ingested table: committed rows only, newest days first, with pages that belong together.

The first page pins what is committed: the last batch of the commit log and the generation of the table's manifest. Both
travel in the cursor, so a walk sees one state of the table however much is ingested or compacted meanwhile. A cursor
without them, or whose generation is no longer kept, goes on with what is committed now.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.fixed_values import DEFAULT_LIMIT, ERROR_CURSOR
from emberlog.functions.cursors import read_snapshot, read_token
from emberlog.operators.filters import Filters, apply_filters, check_filters, check_limit
from emberlog.operators.paging import LogPage, page_from, with_token
from emberlog.operators.search import newest_first
from emberlog.schema import LOG_SCHEMA
from emberlog.session import prepare
from emberlog.sources.commits import committed_batch
from emberlog.sources.manifest import read_manifest
from emberlog.sources.skipping import files_without, probes
from emberlog.sources.tables import read_logs, stored_days

SNAPSHOT = ("batch", "generation")
#: Rows that a walk reads at once after its first page; what the driver holds of it at most, but for a page.
READ_AHEAD = 50_000


def current_snapshot(spark: SparkSession, root: str) -> dict[str, int]:
    """The committed state of the table below ``root``; batch -1 before the first commit."""
    # The manifest first: compaction covers only what is committed.
    generation = read_manifest(spark, f"{root.rstrip('/')}/logs").generation
    last = committed_batch(spark, root)
    return dict(zip(SNAPSHOT, (-1 if last is None else last, generation)))


def _snapshot(spark: SparkSession, root: str, cursor: str | None) -> dict[str, int]:
    now = current_snapshot(spark, root)
    pinned = read_snapshot(cursor, SNAPSHOT) if cursor is not None else None
    if pinned is None or not -1 <= pinned["batch"] <= now["batch"] or not -1 <= pinned["generation"] <= now["generation"]:
        return now
    # Before its first change a table has no manifest; that change puts the state before it down as generation 0.
    generation = max(pinned["generation"], min(0, now["generation"]))
    kept = generation == now["generation"] or read_manifest(spark, f"{root.rstrip('/')}/logs", generation) is not None
    return pinned | {"generation": generation} if kept else now


def _days(spark: SparkSession, path: str, filters: Filters, cursor: tuple[datetime, int] | None) -> list[date]:
    """The stored days that the range and the cursor leave, newest first."""
    upper = min([t.date() for t in (filters.until, cursor and cursor[0]) if t], default=date.max)
    lower = filters.since.date() if filters.since else date.min
    return [day for day in reversed(stored_days(spark, path)) if lower <= day <= upper]


def search_table(
    spark: SparkSession, root: str, *, limit: int = DEFAULT_LIMIT, cursor: str | None = None, **filters
) -> LogPage:
    """One page of the committed rows of the table below ``root``, and the cursor of the next.

    Days are disjoint in time, so the newest days that hold ``limit + 1`` matches hold the page. The first step reads one
    day, later ones as many as the matches so far call for, or eight times as many if there were none. Only the folders
    of the days in a step are listed, of these only the files that may hold the text and the attributes are opened, and
    only the sort key and the filtered columns of these are read. Whole rows are read at the end, from the days the page
    is in.
    """
    size, checked = check_limit(limit), check_filters(**filters)
    place = read_token(prepare(spark), cursor) if cursor is not None else None
    pinned, path = _snapshot(spark, root, cursor), f"{root.rstrip('/')}/logs"

    def matching(days: list[date], without: list[str]) -> DataFrame:
        logs = read_logs(spark, path, pinned["batch"], days, pinned["generation"], without)
        return apply_filters(logs, cursor=place, **filters)

    wanted = probes(spark, checked.q, checked.attrs)
    pending, step, missing, seen = _days(spark, path, checked, place), 1, size + 1, 0
    found_on: list[date] = []
    left_out: list[str] = []
    oldest = None
    while pending and missing > 0:
        chunk, pending = pending[:step], pending[step:]
        seen += len(chunk)
        without = files_without(spark, path, chunk, wanted)
        keys = matching(chunk, without).select(F.unix_micros("timestamp").alias("micros"), "id", "event_date")
        newest = keys.orderBy(F.desc("micros"), F.desc("id")).limit(missing).toArrow()
        if newest.num_rows:
            oldest = newest.column("micros")[newest.num_rows - 1].as_py()
            missing -= newest.num_rows
            found_on += sorted(set(newest.column("event_date").to_pylist()))
            left_out += without
        found = size + 1 - missing
        step = step * 8 if not found else max(1, math.ceil(1.5 * seen * missing / found))
    if oldest is None:
        return LogPage(spark.createDataFrame([], LOG_SCHEMA), None)
    bound = F.timestamp_micros(F.lit(oldest).cast("long"))
    rows = matching(sorted(set(found_on)), left_out).where(F.col("timestamp") >= bound)
    return page_from(with_token(newest_first(rows, size + 1), pinned).toArrow(), size, rows)


def _cuts(rows: DataFrame) -> list[int]:
    """Instants in microseconds, newest first, with about ``READ_AHEAD`` rows between each and the next."""
    parts = rows.count() // READ_AHEAD + 1
    if parts == 1:
        return []
    shares = [1 - n / parts for n in range(1, parts)]
    return rows.agg(F.percentile_approx(F.unix_micros("timestamp"), shares, max(10_000, 20 * parts))).first()[0]


def _pages(found: pa.Table, size: int, df: DataFrame, last: bool) -> Iterator[LogPage]:
    """The pages of rows in order that another row follows, and if these are the ``last`` rows, the one that ends the walk."""
    while found.num_rows > size:
        yield page_from(found.slice(0, size + 1), size, df)
        instant, row_id = (found.column(name)[size - 1] for name in ("timestamp", "id"))
        if not row_id.is_valid:
            raise ValueError(ERROR_CURSOR)
        found = found.slice(size)
        if found.column("timestamp")[0] == instant:
            # As the cursor does: of the rows at its instant only those with a smaller id follow.
            older = pc.or_(pc.not_equal(found.column("timestamp"), instant), pc.less(found.column("id"), row_id))
            found = found.filter(pc.fill_null(older, False))
    if last:
        yield page_from(found, size, df)


def walk_table(spark: SparkSession, root: str, *, limit: int = DEFAULT_LIMIT, **filters) -> Iterator[LogPage]:
    """All pages of one snapshot, in order: those that :func:`search_table` gives when it is asked for each.

    The first page is such a search. For the others, one scan of the instants finds where to cut the rest into runs of
    ``READ_AHEAD`` rows; each run is read by one job, from the row groups of its own time range, and handed out page by
    page. So a walk reads every row a constant number of times, however many pages a day has. A run with more rows than
    expected is read in several steps.
    """
    page = search_table(spark, root, limit=limit, **filters)
    yield page
    if page.next_cursor is None:
        return
    size, checked, path = check_limit(limit), check_filters(**filters), f"{root.rstrip('/')}/logs"
    wanted = probes(spark, checked.q, checked.attrs)

    def remaining(cursor: str, low: int | None) -> tuple[DataFrame, dict[str, int]]:
        """The rows behind the cursor and not before ``low``, and their snapshot."""
        place, pinned = read_token(spark, cursor), _snapshot(spark, root, cursor)
        first = date.min if low is None else (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=low)).date()
        days = [day for day in _days(spark, path, checked, place) if day >= first]
        logs = read_logs(spark, path, pinned["batch"], days, pinned["generation"], files_without(spark, path, days, wanted))
        rows = apply_filters(logs, cursor=place, **filters)
        return (rows if low is None else rows.where(F.col("timestamp") >= F.timestamp_micros(F.lit(low).cast("long")))), pinned

    cursor, most = page.next_cursor, READ_AHEAD + size + 1
    for low in [*_cuts(remaining(cursor, None)[0]), None]:
        whole = False
        while not whole:
            rows, pinned = remaining(cursor, low)
            found = with_token(newest_first(rows, most), pinned).toArrow()
            whole = found.num_rows < most
            for page in _pages(found, size, rows, whole and low is None):
                yield page
                if page.next_cursor is not None:
                    cursor = page.next_cursor
