import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions.text import contains_pattern, trim_white_space, utf16_length

TEXTS = ["", "a", "b", "ab", "ba", "A%b", "a_b", "a\\b", "aab b", "abab", "B.A", "b\na", "é%É", "%", "\\", "a+b(", "ba%"]


def expected(text: str, q: str) -> bool:
    """The definition, by plain backtracking."""
    out, rest = "", f"%{q}%"
    while rest:
        char, rest = rest[0], rest[1:]
        if char == "\\" and rest:
            out, rest = out + re.escape(rest[0].lower()), rest[1:]
        else:
            out += {"%": ".*", "_": "."}.get(char, re.escape(char.lower()))
    return re.fullmatch(out, text.lower(), re.DOTALL) is not None


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB%_\\.é\n+(", min_size=1, max_size=6), min_size=8, max_size=8))
def test_contains_pattern(spark, patterns):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = df.select("t", *[contains_pattern(F.col("t"), q).alias(f"c{i}") for i, q in enumerate(patterns)]).collect()
    for row in found:
        for q, hit in zip(patterns, row[1:]):
            assert hit == expected(row.t, q), (row.t, q)


def test_plain_word_is_a_substring_test(spark):
    plan = spark.range(1).select(contains_pattern(F.col("id").cast("string"), "A.b"))._jdf.queryExecution().toString()
    assert "RLIKE" not in plan.upper() and "contains" in plan.lower()


def test_many_wildcards_on_a_long_text(spark):
    """Quadratic or worse if pieces were matched in every combination."""
    df = spark.range(1).select(F.repeat(F.lit("the "), 200_000).alias("t"))
    assert df.where(contains_pattern(F.col("t"), "the%the%the%data")).count() == 0
    assert df.where(contains_pattern(F.col("t"), "the%the%the%the _he")).count() == 1


def test_trim_and_length(spark):
    df = spark.createDataFrame([("\t  a b﻿\n",), ("\U0001f600é",), ("\x1f\x85",)], "t string")
    rows = df.select(trim_white_space(F.col("t")).alias("t"), utf16_length(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("a b", 8), ("\U0001f600é", 3), ("\x1f\x85", 2)]
