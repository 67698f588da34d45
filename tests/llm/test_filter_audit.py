"""The audit of five filters against a plain count over every order."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from emberlog.llm import filter_audit

WORDS = "\x20\t\n\x0b\x0c\r"
COLUMNS = "doc_id long, text string, source string, mask int, n int, part string, h1 long"


def words(text):
    for blank in WORDS[1:]:
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, labels):
    failing = []
    for doc_id, text, source in rows:
        text = text or ""
        found = words(text)
        same = [d for d, t, _ in rows if (t or "") == text and d is not None]
        fails = {
            "A": len(found) < 200,
            "B": 100 * len(set(found)) < 50 * len(found),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(d < doc_id for d in same),
        }
        failing.append((source or "", {k for k, v in fails.items() if v}, doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    orders = ["".join(p) for p in permutations("ABCDE")]
    shapley = {}
    for part, fails, _ in failing:
        for order in orders:
            for letter in order:
                if letter in fails:
                    shapley[part, letter] = shapley.get((part, letter), 0) + 1
                    break
    out = set()
    for part in {p for p, _, _ in failing}:
        own = [(f, d) for p, f, d in failing if p == part]
        for order in orders:
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for f, d in own if letter in f and not f & before]
                out.add(
                    (
                        part, order, step,
                        sum(not f & (before | {letter}) for f, _ in own),
                        len(removed),
                        sum(letter in f and bool(f & before) for f, _ in own),
                        sum(f == {letter} for f, _ in own),
                        sum(d in good for d in removed),
                        sum(d in toxic for d in removed),
                        shapley.get((part, letter), 0),
                    )
                )
    return out


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "a"),
    (2, LONG, "b"),
    (2, LONG, "b"),
    (3, LONG, None),
    (None, LONG, "a"),
    (None, LONG, "a"),
    (4, LONG + " $", "a"),
    (5, "AB " * 300, "a"),
    (6, "AB " * 300, ""),
    (7, None, "a"),
    (8, "", "b"),
    (9, " \t\r\n\x0b\x0c ", "b"),
    (10, "é\U0001f600 " * 300, "a"),
    (11, "A" + "é" * 49, "a"),
    (12, "A" + "é" * 50, "a"),
    (13, LONG + " % A", "c"),
    (-5, LONG + " % A", "c"),
    (14, "x" * 300_000 + "|", "c"),
    (15, "w1 " * 200_000, "c"),
]
LABELS = [(2, 1, 0), (3, 1, 1), (3, 0, 1), (6, None, 1), (8, 1, None), (13, 1, 1), (99, 1, 1), (None, 1, 1)]


def report(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], COLUMNS)
    marks = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    found = filter_audit.audit_filters(docs, marks)
    return [tuple(r) for r in found.collect()]


def test_against_plain_count(spark):
    found = report(spark, ROWS, LABELS)
    assert len(found) == len(set(found)) == 4 * 600
    assert set(found) == brute(ROWS, LABELS)


def test_hot_text_and_no_labels(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}", f"s{i % 2}") for i in range(3000)]
    found = {r[:5] for r in report(spark, rows, []) if r[1] == "EABCD" and r[2] == 1}
    assert found == {("s0", "EABCD", 1, 1001, 499), ("s1", "EABCD", 1, 1000, 500)}


def test_empty(spark):
    assert report(spark, [], LABELS) == []


@pytest.mark.parametrize("copies", [0, 400])
def test_prepass_clears_unique_texts(spark, copies):
    """Every repeat stays, and at least nine of ten unique texts are cleared."""
    texts = spark.range(20_000).select(F.concat(F.lit("t"), F.when(F.col("id") < copies, 0).otherwise(F.col("id"))).alias("text"), "id")
    rows = texts.select(F.col("id").alias("doc_id"), F.lit("").alias("part"), F.lit(0).alias("mask"), *filter_audit._text_hashes(F.col("text")))
    kept = {r.doc_id for r in filter_audit.possible_repeats(rows.cache()).select("doc_id").collect()}
    assert set(range(copies)) <= kept
    assert len(kept) < copies + 2_000


def test_failures_of_a_text():
    assert filter_audit.failures(b"") == 1
    assert filter_audit.failures(LONG.encode()) == 0
    assert filter_audit.failures("Aé".encode() * 300) == 1 | 4
