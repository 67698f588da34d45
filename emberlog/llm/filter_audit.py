"""What five document filters remove, in every order they could be applied in, by source.

Four of the filters look at a text alone; the fifth asks whether a smaller id has the same text anywhere in the table.
A counting-Bloom prepass keeps that question small:

1. One pass over the texts gives each row its failed filters as a bit mask and 192 bits of text hash; nothing else is
   kept. A text counts up ``CELLS`` of the 64 counters of one word of the sketch. The tasks' sketches are merged by
   adding up; of a word those counters stay that reached two, as the bits of one number.
2. A text with a counter that stayed at one is guaranteed unique. Only the others, the possible repeats, are looked up
   in a second pass (a bitmap of their hashes tells them) and shuffled with their texts, for the exact smallest id of
   every full text.
3. The rows that fail then move from their mask to the mask with that filter. All counts are sums over masks, so that
   nothing but a few groups (part, mask) is left for the orders, where each step is a few bit tests.

The sketch has a fixed number of counters per row of the table and is joined by word, so that it grows with the input,
is never held in one place and clears the same share of the unique texts at every size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import looked_up, power_of_two, ready, single_bit
from emberlog.session import materialise

FILTERS = "ABCDE"
#: Limits of the filters; fixed values.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"

#: Counters of the sketch per row of the table, counters in a word of it, and counters that a text counts up.
COUNTERS_PER_ROW = 16
WORD_COUNTERS = 64
CELLS = 3
#: A word is hot if one of its counters has a share of 1/HOT of all rows. There are ``CELLS * HOT`` at most, which is
#: the bound of what is broadcast so that the rows of such a word need not meet in one task.
HOT = 10_000

_DUPLICATE = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))

_HASHES = ("h1", "h2", "h3")
_ROW = "doc_id long, part string, mask int, h1 long, h2 long, h3 long"
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), *((h, pa.int64()) for h in _HASHES)])


def failures(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits 0 to 3."""
    words = text.split()
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _judged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        doc_id, part, text, *hashes = batch.columns
        masks = pa.array([failures(t) for t in text.to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([doc_id, part, masks, *hashes], schema=_ROW_ARROW)


def _text_hashes(text: Column) -> list[Column]:
    """Three hashes of a text that are as good as independent."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.xxhash64(F.lit(2), text).alias("h3")]


def _place(words: int) -> tuple[Column, list[Column]]:
    """The word of a row in the sketch and the counters there, which may coincide."""
    cells = [F.shiftrightunsigned("h2", 8 * i).bitwiseAND(WORD_COUNTERS - 1).cast("int") for i in range(CELLS)]
    return F.pmod("h1", F.lit(words)).alias("word"), cells


def merged_sketch(rows: DataFrame, words: int) -> DataFrame:
    """``(word, twice, most)``: the counters of a word that reached two, as bits, and the largest of them."""
    word, cells = _place(words)
    counted = rows.select(word, F.explode(F.array_distinct(F.array(*cells))).alias("cell")).groupBy("word", "cell").agg(F.count("*").alias("held"))
    return counted.filter("held > 1").groupBy("word").agg(F.bit_or(single_bit(F.col("cell"))).alias("twice"), F.max("held").alias("most"))


def possible_repeats(rows: DataFrame) -> DataFrame:
    """The rows whose counters all reached two: every row of a text that stands twice, and a few others."""
    total = rows.count()
    words = power_of_two(-(-total * COUNTERS_PER_ROW // WORD_COUNTERS))
    word, cells = _place(words)
    sketch = materialise(merged_sketch(rows, words), "merged-sketch")
    placed = rows.select(*rows.columns, word, reduce(Column.bitwiseOR, map(single_bit, cells)).alias("bits"))
    hot = F.broadcast(sketch.filter(F.col("most") * HOT >= total).drop("most"))
    there = F.col("twice").bitwiseAND(F.col("bits")) == F.col("bits")
    at_hot = placed.join(hot, "word").filter(there)
    elsewhere = placed.join(hot.select("word"), "word", "left_anti").join(sketch.drop("most"), "word").filter(there)
    return at_hot.union(elsewhere.select(*at_hot.columns)).select(*rows.columns)


def first_ids(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2, h3)``: the smallest id of every full text among the possible repeats."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = looked_up(texts.withColumn("h3", _text_hashes(F.col("text"))[2]), repeats.select("h3"), "h3")
    first = found.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", *_text_hashes(F.col("text")))


def judged_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, n)``: rows by the filters they fail, to be added up; ``n`` may be negative.

    A row stands under its mask without the duplicate filter; one that fails that filter is taken off there and added
    under the mask with it.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], F.coalesce(docs["source"], F.lit("")).alias("part"), text.cast("binary").alias("text"), *_text_hashes(text))
    rows = materialise(rows.mapInArrow(_judged, _ROW), "filter-masks")
    repeats = materialise(possible_repeats(rows).filter("doc_id IS NOT NULL").groupBy(*rows.columns).agg(F.count("*").alias("n")), "possible-repeats")
    firsts = first_ids(docs, repeats)
    failing = materialise(repeats.join(firsts, ["doc_id", *_HASHES], "left_anti").select("doc_id", "part", "mask", "n"), "duplicate-rows")
    moved = F.inline(F.array(F.struct("mask", (-F.col("n")).alias("n")), F.struct(F.col("mask").bitwiseOR(_DUPLICATE).alias("mask"), "n")))
    return rows.select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n")).union(failing.select("doc_id", "part", moved))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows that fail exactly these filters, and how many of them are labelled so."""
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    marks = marks.filter("doc_id IS NOT NULL AND good + toxic > 0")
    single = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).filter("doc_id IS NOT NULL AND n <> 0")
    marked = single.join(marks, "doc_id").groupBy("part", "mask").agg(
        F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    zero = F.lit(0).cast("long")
    all_rows = rows.groupBy("part", "mask").agg(F.sum("n").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    both = all_rows.union(marked.select("part", "mask", zero, "good", "toxic"))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _steps() -> Column:
    """All steps of all orders: the order, the step, the bit of its filter and the bits of those before."""
    bits = {letter: 1 << place for place, letter in enumerate(FILTERS)}
    steps = [
        {"filter_order": "".join(order), "step": place + 1, "bit": bits[letter], "before": sum(bits[x] for x in order[:place])}
        for order in permutations(FILTERS)
        for place, letter in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def in_every_order(counts: DataFrame) -> DataFrame:
    """The report from counts by mask."""
    mask, bit, n = F.col("mask"), F.col("bit"), F.col("n")
    at_step = counts.select("*", F.inline(_steps()))
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier

    def total(condition: Column, amount: Column = n) -> Column:
        return F.sum(F.when(condition, amount).otherwise(0)).cast("long")

    # Of all orders, a filter comes first among the k that a row fails in one of k.
    orders = len(list(permutations(FILTERS)))
    return at_step.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(here).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(here, F.col("good")).alias("good_lost"),
        total(here, F.col("toxic")).alias("toxic_lost"),
        total(fails, n * F.expr(f"{orders} div greatest(1, bit_count(mask))")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; further columns, of any name, are left
    out. A null text counts as empty, a null source as the empty one. Repeated rows count each; equal ids with equal
    texts are no duplicates of each other. A row without an id is no duplicate and makes none, and has no labels. Of
    several labels of an id one suffices. An empty table gives no row, an empty or null label table no lost documents.
    """
    ready(docs.sparkSession)
    return in_every_order(mask_counts(judged_rows(docs), labels))
