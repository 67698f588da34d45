"""JSON values held as VARIANT: type tests and their text forms."""

from __future__ import annotations

from decimal import Decimal
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, name: str) -> Column:
    """Member of an object, still a VARIANT; NULL if ``value`` is no object or lacks it."""
    return F.variant_get(value, f"$['{name}']", "variant")


def kind(value: Column) -> Column:
    """``STRING``, ``BIGINT``, ``DECIMAL(p,s)``, ``DOUBLE``, ``BOOLEAN``, ``VOID``, ``OBJECT<…>`` or ``ARRAY<…>``;
    NULL for an absent value."""
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("OBJECT<")), F.lit(False))


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_map(value: Column) -> Column:
    """Object as ``map<string,variant>``; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def attribute_equals(attributes_json: Column, key: str, text: str) -> Column:
    """Whether an attribute of a JSON object column, as canonical text, equals ``text``.

    The key is literal, never a path. Only numbers written with an exponent are not canonical as they stand; they
    are compared by value, and only if ``text`` is the form such a value would have.
    """
    document = F.try_parse_json(attributes_json)
    quotable = not any(c in key for c in "'\"\\")
    value = field(document, key) if quotable else F.try_element_at(as_map(document), F.lit(key))
    number = _double_with_text(text)
    same_number = F.lit(False) if number is None else F.try_variant_get(value, "$", "double") == F.lit(number)
    return F.when(kind(value) == "DOUBLE", same_number).otherwise(as_string(value) == text)


def _double_with_text(text: str) -> float | None:
    """The double whose plain decimal form is exactly ``text``."""
    try:
        number = float(text)
    except ValueError:
        return None
    plain = format(Decimal(repr(number)), "f") if isfinite(number) else ""
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return number if plain == text else None


# The longer expressions below are SQL text: one parsed string costs the driver far less than a hundred column calls,
# and a micro-batch builds them every time. Arguments and results are SQL expressions.


def _plain_number(text: str) -> str:
    """A double as the JVM prints it, rewritten as a plain decimal: no exponent, no trailing zeros, no minus zero."""
    body = f"TRIM(LEADING '-' FROM {text})"
    power = f"try_cast(substring_index({body}, 'E', -1) AS INT)"
    digits = f"TRIM(TRAILING '0' FROM replace(substring_index({body}, 'E', 1), '.', ''))"
    # The mantissa has one digit before its point, so the value's point sits after 1 + power digits.
    large = (
        f"concat(rpad(substr({digits}, 1, {power} + 1), {power} + 1, '0'),"
        f" if(length({digits}) > {power} + 1, concat('.', substr({digits}, {power} + 2)), ''))"
    )
    small = f"concat('0.', repeat('0', -{power} - 1), {digits})"
    return f"""CASE
      WHEN {text} IN ('0.0', '-0.0') THEN '0'
      WHEN NOT contains({text}, 'E') THEN TRIM(TRAILING '.' FROM TRIM(TRAILING '0' FROM {text}))
      ELSE concat(if(startswith({text}, '-'), '-', ''), if({power} >= 0, {large}, {small})) END"""


def _scalar_text(value: str) -> str:
    """A value as the text attribute filters compare: numbers canonical, strings bare, JSON null NULL."""
    text = f"try_variant_get({value}, '$', 'string')"
    return f"""CASE WHEN schema_of_variant({value}) <> 'DOUBLE' OR {text} IN ('Infinity', '-Infinity', 'NaN') THEN {text}
      ELSE {_plain_number(text)} END"""


def attribute_text(attributes: str) -> Column:
    """``map<string,variant>`` → ``map<string,string>`` of canonical texts."""
    return F.expr(f"transform_values({attributes}, (name, value) -> {_scalar_text('value')})")


def attribute_text_of_json(column: str) -> Column:
    """The same for a column of JSON objects."""
    return attribute_text(f"try_variant_get(try_parse_json({column}), '$', 'map<string,variant>')")


def displayed(value: str) -> str:
    """A rejected value as it reads when put into a message: absent ``undefined``, null ``null``, objects
    ``[object Object]``, arrays their elements joined by commas, at any depth."""

    def is_array(item: str) -> str:
        return f"startswith(coalesce(schema_of_variant({item}), 'VOID'), 'ARRAY<')"

    def single(item: str) -> str:
        kind_of = f"schema_of_variant({item})"
        text = f"try_variant_get({item}, '$', 'string')"
        size = f"abs(try_variant_get({item}, '$', 'double'))"
        return f"""CASE
          WHEN startswith({kind_of}, 'OBJECT<') THEN '[object Object]'
          WHEN {kind_of} <> 'DOUBLE' OR {text} IN ('Infinity', '-Infinity') THEN {text}
          WHEN {size} >= 1e21 OR ({size} < 1e-6 AND {size} > 0) THEN
            regexp_replace(lower(replace({text}, '.0E', 'E')), 'e([0-9])', 'e+$1')
          ELSE {_plain_number(text)} END"""

    # Every step opens the arrays among the items; there are no more levels than opening brackets. An empty one reads ''.
    inner = "try_variant_get(item, '$', 'array<variant>')"
    opened = f"CASE WHEN NOT {is_array('item')} THEN array(item) WHEN size({inner}) = 0 THEN array(parse_json('\"\"')) ELSE {inner} END"
    json = f"to_json({value})"
    items = f"""aggregate(sequence(1, length({json}) - length(replace({json}, '[', ''))),
        named_struct('items', array({value}), 'open', true),
        (state, step) -> if(state.open, named_struct(
          'items', flatten(transform(state.items, item -> {opened})), 'open', exists(state.items, item -> {is_array('item')})), state),
        state -> array_join(transform(state.items, item -> if(coalesce(schema_of_variant(item), 'VOID') = 'VOID', '', {single('item')})), ','))"""
    return f"""CASE
      WHEN schema_of_variant({value}) IS NULL THEN 'undefined'
      WHEN schema_of_variant({value}) = 'VOID' THEN 'null'
      WHEN {is_array(value)} THEN {items}
      ELSE {single(value)} END"""
