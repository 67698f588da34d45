"""Counts that are served from the one-minute rollup wherever it gives the exact answer."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timestamps import bucket_start, request_instant
from emberlog.operators.aggregate import (
    aggregate_logs,
    check_aggregate,
    count_by,
    group_column,
    rollup_predicates,
)
from emberlog.operators.filters import Filters, predicates, time_predicates
from emberlog.sources.tables import committed_batch, read_logs, read_rollup

_MINUTE = timedelta(minutes=1)


def can_use_rollup(
    bucket: str, q: str | None = None, attrs: Mapping | None = None, *, any_bucket: bool = False
) -> bool:
    """The rollup knows minute, service and level only. Minute counts add up, so ``any_bucket`` may widen it."""
    return (bucket == "1m" or any_bucket) and q is None and not attrs


def whole_minutes(since: datetime, until: datetime) -> tuple[datetime, datetime]:
    """Largest range of complete minutes inside ``[since, until)``; empty if the start is not before the end."""
    start = since.replace(second=0, microsecond=0)
    return (start if start == since else start + _MINUTE), until.replace(second=0, microsecond=0)


def aggregate_auto(
    logs: DataFrame,
    rollup: DataFrame,
    since: str | datetime,
    until: str | datetime,
    bucket: str,
    *,
    group_by: str | None = None,
    service: str | None = None,
    level: str | None = None,
    q: str | None = None,
    attrs: Mapping[str, object] | None = None,
    any_bucket: bool = False,
) -> DataFrame:
    """Same result as :func:`aggregate_logs` over ``logs``.

    Complete minutes come from the rollup, the two partial minutes at the edges from the rows; both go through one
    aggregation. Anything the rollup cannot answer is counted from the rows.
    """
    checked = check_aggregate(since, until, bucket, group_by, service=service, level=level, q=q, attrs=attrs)
    start, end = whole_minutes(checked.since, checked.until)
    if not can_use_rollup(bucket, checked.q, checked.attrs, any_bucket=any_bucket) or start >= end:
        return aggregate_logs(
            logs, since, until, bucket, group_by=group_by, service=service, level=level, q=q, attrs=attrs
        )

    def keyed(df: DataFrame, instant: str, amount) -> DataFrame:
        return df.select(
            bucket_start(F.col(instant), bucket).alias("bucket_start"),
            group_column(group_by).alias("group_value"),
            amount.alias("amount"),
        )

    interior = rollup.where(reduce(and_, rollup_predicates(rollup, start, end, checked)))
    pieces = [keyed(interior, "bucket_start", F.col("count"))]
    edges = [(lower, upper) for lower, upper in ((checked.since, start), (end, checked.until)) if lower < upper]
    if edges:
        # One scan for both: the days of either, then the instants of either.
        inside = reduce(or_, (reduce(and_, time_predicates(logs, lower, upper)) for lower, upper in edges))
        others = predicates(logs, Filters(service=checked.service, level=checked.level))
        if "event_date" in logs.columns:
            others.append(F.col("event_date").isin({day for lower, upper in edges for day in (lower.date(), upper.date())}))
        pieces.append(keyed(logs.where(reduce(and_, [*others, inside])), "timestamp", F.lit(1).cast("long")))
    return count_by(reduce(DataFrame.unionByName, pieces), group_by, F.sum("amount"))


def aggregate_table(spark: SparkSession, root: str, since, until, bucket: str, **params) -> DataFrame:
    """:func:`aggregate_auto` over an ingested table, on batches whose logs and rollup are both complete.

    Only the folders of the days in the range are listed. Before the first batch the result is empty.
    """
    upto = committed_batch(spark, root)
    upto = -1 if upto is None else upto
    base, days = root.rstrip("/"), named_days(since, until)
    logs = read_logs(spark, f"{base}/logs", upto, days)
    rollup = read_rollup(spark, f"{base}/rollup", upto, days)
    return aggregate_auto(logs, rollup, since, until, bucket, **params)


def named_days(since, until) -> list[date] | None:
    """The days a valid range touches; ``None`` without one, which the aggregate then refuses."""
    if since is None or until is None:
        return None
    first, last = request_instant(since, "since").date(), request_instant(until, "until").date()
    count = (last - first).days + 1
    return [first + timedelta(days=n) for n in range(count)] if count > 0 else None
