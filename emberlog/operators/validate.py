"""Entry validation: a data-quality job that gives every entry its verdict and normal form in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions.text import matches, trim_white_space, utf16_length
from emberlog.functions.timestamps import parse_instant
from emberlog.functions.variants import (
    as_map,
    as_string,
    attribute_text,
    displayed,
    field,
    is_object,
    is_string,
)

ACCEPTED_COLUMNS = ("timestamp", "level", "service", "message", "attributes", "attr_text")


_FIELDS = ("timestamp", "level", "service", "message", "attributes")


def _string(value: Column) -> Column:
    return F.when(is_string(value), as_string(value))


def _text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The first rule that fails names the reason; NULL means accepted. A NULL text stands for a missing value or one of
# another type. The level is rendered in a lambda, which keeps a large expression needed for few rows out of the
# generated code: that of the hot path must remain small enough for the JIT compiler.
_REASON = f"""CASE
  WHEN _refused IS NOT NULL THEN _refused
  WHEN _ts_text IS NULL AND NOT _is_object THEN {_text(fixed.REASON_ENTRY)}
  WHEN _ts_text IS NULL THEN {_text(fixed.REASON_TIMESTAMP_MISSING)}
  WHEN timestamp IS NULL THEN concat({_text(fixed.REASON_TIMESTAMP_INVALID)}, _ts_text, {_text("'")})
  WHEN timestamp > _now + INTERVAL {fixed.MAX_FUTURE_SECONDS} SECONDS THEN
    concat({_text(fixed.REASON_TIMESTAMP_FUTURE)}, _ts_text, {_text("'")})
  WHEN level IS NULL OR level NOT IN ({", ".join(map(_text, fixed.LEVELS))}) THEN
    concat({_text(fixed.REASON_LEVEL)}, element_at(transform(array(_level), v -> {displayed("v")}), 1), {_text("'")})
  WHEN service IS NULL THEN {_text(fixed.REASON_SERVICE_MISSING)}
  WHEN _service_length NOT BETWEEN 1 AND {fixed.MAX_SERVICE_LENGTH} THEN {_text(fixed.REASON_SERVICE_EMPTY)}
  WHEN message IS NULL THEN {_text(fixed.REASON_MESSAGE_MISSING)}
  WHEN _message_length NOT BETWEEN 1 AND {fixed.MAX_MESSAGE_LENGTH} THEN {_text(fixed.REASON_MESSAGE_EMPTY)}
  WHEN _attributes IS NOT NULL AND (_attr_map IS NULL OR NOT forall(map_values(_attr_map),
    v -> NOT schema_of_variant(v) RLIKE '^(VOID|OBJECT<|ARRAY<)')) THEN {_text(fixed.REASON_ATTRIBUTES)}
END"""


def check_entries(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Replace ``entry VARIANT`` by ``reason`` (NULL: accepted) and the accepted columns.

    ``now`` is read once per query. Rows whose ``entry`` is absent altogether (a refused envelope) keep the reason
    they came with.
    """
    carried = [c for c in entries.columns if c not in ("entry", "reason")]
    refused = F.col("reason") if "reason" in entries.columns else F.lit(None).cast("string")
    fields = entries.select(
        *carried,
        "entry",
        (F.current_timestamp() if now is None else now).alias("_now"),
        F.when(F.col("entry").isNull(), refused).alias("_refused"),
        *[field(F.col("entry"), name).alias(f"_{name}") for name in _FIELDS],
    )
    texts = fields.select(
        *carried,
        "_now",
        "_refused",
        "_level",
        "_attributes",
        F.when(~is_string(F.col("_timestamp")), is_object(F.col("entry"))).alias("_is_object"),
        _string(F.col("_timestamp")).alias("_ts_text"),
        _string(F.col("_level")).alias("level"),
        trim_white_space(_string(F.col("_service"))).alias("service"),
        trim_white_space(_string(F.col("_message"))).alias("message"),
    )
    ts_text = F.col("_ts_text")
    parsed = texts.select(
        "*",
        F.when(matches(ts_text, fixed.ENTRY_TIMESTAMP_PATTERN), parse_instant(ts_text)).alias("timestamp"),
        as_map(F.col("_attributes")).alias("_attr_map"),
        utf16_length(F.col("service")).alias("_service_length"),
        utf16_length(F.col("message")).alias("_message_length"),
    )
    verdict = parsed.select("*", F.expr(_REASON).alias("_verdict"))
    accepted = F.col("_verdict").isNull()
    result = F.struct(
        F.col("_verdict").alias("reason"),
        *[F.when(accepted, F.col(c)).alias(c) for c in ("timestamp", "level", "service", "message")],
        F.when(accepted, F.coalesce(F.to_json("_attributes"), F.lit("{}"))).alias("attributes"),
        F.when(
            accepted, F.coalesce(attribute_text("_attr_map"), F.create_map().cast("map<string,string>"))
        ).alias("attr_text"),
    )
    # A generator is where predicate pushdown stops: a filter on ``reason`` would otherwise be rewritten in terms of
    # the raw entry and decide everything a second time.
    return verdict.select(*carried, F.inline(F.array(result)))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in normal form, and rejected rows with index and reason."""
    carried = [c for c in checked.columns if c not in (*ACCEPTED_COLUMNS, "reason")]
    accepted = checked.where(F.col("reason").isNull()).select(*carried, *ACCEPTED_COLUMNS)
    rejected = checked.where(F.col("reason").isNotNull()).select("envelope_id", "index", "reason")
    return accepted, rejected


def validate_entries(entries: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(envelope_id, index, entry VARIANT)`` → ``(accepted, rejected)``.

    Both are lazy filters over the same plan; persist :func:`check_entries` first when writing both.
    """
    return split_checked(check_entries(entries, now))


def ingest_summary(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per envelope: accepted count, rejected entries by index, and 200 if any entry was accepted, else 400.

    For the two halves as stored; over entries just checked :func:`summarise` needs only one pass.
    """
    verdicts = accepted.select("envelope_id", "index", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("envelope_id", "index", "reason")
    )
    return summarise(verdicts)


def summarise(verdicts: DataFrame, *carried: str) -> DataFrame:
    """:func:`ingest_summary` over ``(envelope_id, index, reason)``; ``carried`` columns are those of the whole envelope.

    The list per envelope is never longer than the one document it came from. Entries of an envelope sit in one
    task, so the partial aggregate already leaves a single row per envelope to shuffle.
    """
    issue = F.when(F.col("reason").isNotNull() & F.col("index").isNotNull(), F.struct("index", "reason"))
    return verdicts.groupBy("envelope_id", *carried).agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.array_sort(F.collect_list(issue)).alias("rejected"),
        F.when(F.count_if(F.col("reason").isNull()) > 0, F.lit(200)).otherwise(F.lit(400)).alias("status"),
    )
