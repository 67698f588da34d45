"""How far the sources of each language lie apart in their words, and which words set a source apart, exactly.

*Duplicate-text collapse.* Identical texts of a language become one row with the list of sources they stand in and how
often, so that each is read and cut into terms once, whatever the number of its copies. Only one text a task and group
is shuffled; the copies travel as counts. Texts are identical if language, length and 128 bits of hash are.

*Counting.* Tasks add up term counts and document counts, each weighted by the copies, per language and source; one sum
over (language, source, term) follows. Document frequencies over the language decide which terms are kept.

*Sparse pair evaluation.* A term that a group lacks has the group's base share ``p0``, so that two groups need only be
compared at terms that one of them has. With ``f`` the divergence of two shares, a pair's value is::

    V * f(p0, q0)  +  sum over terms of the one  f(p, q0) - f(p0, q0)  +  the same of the other
                   +  sum over terms of both     f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The first sums need the terms of a group only by share: a histogram. All values are whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch, ready

#: Documents of the language that a kept term stands in at least, and rows of the term part per group; fixed values.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Shares are counted in units of 1/SCALE, every count with so much added; fixed values.
SCALE = 1_000_000_000
ADDED = 2

#: Sums that a task holds before it hands them on.
_MOST_HELD = 400_000

#: Every byte that is no part of a term becomes a blank, A to Z their small letters.
_TO_TERMS = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

_COUNTS = "lang string, source string, term binary, held long, docs long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("held", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """The terms of a text (UTF-8): runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TO_TERMS).split()


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the terms of (lang, text, sources) rows."""
    held: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            own, size = docs[lang, source], len(counts)
            columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array(list(counts), pa.binary())]
            numbers = [pa.array(list(counts.values()), pa.int64()), pa.array([own[t] for t in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], schema=_COUNTS_ARROW)
        held.clear()
        docs.clear()

    waiting = 0
    for batch in rows:
        for lang, text, sources in zip(*(column.to_pylist() for column in batch.columns)):
            found = terms(text)
            counts = Counter(found)
            for entry in sources:
                group, copies = (lang, entry["source"]), entry["copies"]
                before = len(held[group])
                if copies == 1:
                    held[group].update(found if len(sources) == 1 else counts)
                    docs[group].update(counts.keys())
                else:
                    for total, added in ((held[group], counts), (docs[group], dict.fromkeys(counts, 1))):
                        for term, number in added.items():
                            total[term] += copies * number
                waiting += len(held[group]) - before
        if waiting > _MOST_HELD:
            yield from handed_on()
            waiting = 0
    yield from handed_on()


def collapsed(docs: DataFrame) -> DataFrame:
    """``(lang, text, sources)``: each text of a language once, as UTF-8, with its ``(source, copies)``."""
    lang, text, source = (F.coalesce(docs[name], F.lit("")) for name in ("lang", "text", "source"))
    key = ["lang", "length", "h1", "h2"]
    rows = docs.select(
        lang.alias("lang"), source.alias("source"), F.octet_length(text).alias("length"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"),
    )
    copies = rows.groupBy(*key, "source").agg(F.count("*").alias("copies"))
    sources = copies.groupBy(*key).agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(sources, key).select("lang", F.col("text").cast("binary").alias("text"), "sources")


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, held, docs)``: occurrences of a term and documents with it."""
    partial = collapsed(docs).mapInArrow(_counted, _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("held").alias("held"), F.sum("docs").alias("docs"))


def _share(held: str, total: str) -> Column:
    """A count as a share of a total, smoothed; in decimals, as the product may leave 64 bits."""
    return F.expr(f"1 + cast({held} + {ADDED} as decimal(19,0)) * cast({SCALE} as decimal(10,0)) div cast({total} as decimal(20,0))")


def _apart(p: str, q: str) -> str:
    """The divergence of two shares at one term."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _of(table: DataFrame, name: str, *columns: str) -> DataFrame:
    """The columns of one side of a pair: ``source`` becomes ``name``, the others get it as a prefix."""
    return table.select("lang", F.col("source").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))


def kept_terms(counts: DataFrame) -> DataFrame:
    """``(lang, term, in_lang)``: the terms in enough documents of the language, and their occurrences there."""
    by_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("held").alias("in_lang"))
    return by_lang.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")


def group_totals(docs: DataFrame, kept: DataFrame, terms_of_langs: DataFrame) -> DataFrame:
    """``(lang, source, v, total, p0)`` of every group that occurs: kept terms of the language, the denominator of the
    group's shares and its share of a term that it lacks; null where the language keeps no term."""
    groups = docs.select(F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source")).distinct()
    langs = terms_of_langs.groupBy("lang").agg(F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("held").alias("n"))
    sized = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    total = sized.select("lang", "source", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.expr(f"coalesce(n, 0L) + {ADDED} * v").alias("total"))
    return total.withColumn("p0", _share("0L", "total"))


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every two groups of a language, in both directions."""
    pairs = _of(groups, "a", "v", "p0").join(_of(groups, "b", "p0"), "lang").filter("a <> b")
    base = pairs.filter("a < b").select("lang", "a", "b", F.expr(f"coalesce(a_v * {_apart('a_p0', 'b_p0')}, 0L)").alias("value"))

    histogram = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = _of(histogram, "a", "p", "terms").join(pairs, ["lang", "a"])
    value = F.expr(f"a_terms * ({_apart('a_p', 'b_p0')} - {_apart('a_p0', 'b_p0')})")
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), value.alias("value"))

    sides = (_of(cells.withColumnRenamed("term", "word"), name, "word", "p", "p0").withColumnRenamed(f"{name}_word", "word") for name in "ab")
    left, right = sides
    both = left.join(right, ["lang", "word"]).filter("a < b")
    value = F.expr(f"{_apart('a_p', 'b_p')} - {_apart('a_p', 'b_p0')} - {_apart('a_p0', 'b_p')} + {_apart('a_p0', 'b_p0')}")
    both = both.select("lang", "a", "b", value.alias("value"))

    summed = base.union(alone).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(summed.select("lang", "b", "a", "value"))


def divergence(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` has a row for every other source of the language, part ``term`` the ``TOP_TERMS`` kept terms that set
    the source apart most from its language, of those that are more frequent in it. ``docs`` has text, lang and source;
    null counts as the empty text, and further columns, of any name, are left out. Repeated rows count each. A group
    without terms is compared like any other; a source that is alone in its language has no pairs. In a language that
    keeps no term all values are 0. An empty table gives no row.

    A distinct text carries a list of its sources, so that it needs memory by the number of sources, not of copies.
    """
    scratch = Scratch(ready(docs.sparkSession))
    counts = scratch.write(term_counts(docs), "term-counts")
    # The texts were shuffled for that: the most that lies on the disks.
    scratch.free_shuffles()
    in_langs = scratch.write(kept_terms(counts), "kept-terms")
    kept = scratch.write(counts.join(in_langs, ["lang", "term"]).select("lang", "source", "term", "held", "in_lang"), "kept-counts")
    scratch.spent(counts)
    groups = scratch.write(group_totals(docs, kept, in_langs), "group-totals")
    langs = in_langs.groupBy("lang").agg((F.sum("in_lang") + ADDED * F.count("*")).alias("lang_total"))
    cells = kept.join(groups, ["lang", "source"]).join(langs, "lang")
    cells = cells.withColumn("p", _share("held", "total")).withColumn("q", _share("in_lang", "lang_total"))
    cells = scratch.write(cells.select("lang", "source", "term", "p", "p0", "q"), "term-shares")
    scratch.spent(kept, in_langs)
    scratch.free_shuffles()

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_values(cells, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    apart = cells.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    ranked = apart.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.select(*columns).union(ranked.select(*columns))
