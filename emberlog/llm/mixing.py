"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash that depends on nothing but the document. A source's share is a budget of words; the documents
below a hash threshold fill it. The threshold is found by summing words per (source, hash bucket), walking to the bucket
in which the budget ends, and splitting only that bucket further. Nothing is sorted, and the mix is a filter on the hash.
A larger budget gives a higher threshold, so mixes of growing budgets are nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import packed, word_count
from emberlog.session import materialise

#: Bits of the document hash, and bits resolved by one histogram.
HASH_BITS = 60
LEVEL_BITS = 12

_PLAN = "source string, source_size long, target double, base int, threshold long"


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text; null id and null text count as empty."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


@dataclass
class _Share:
    """A source while its threshold is searched: ``low`` is the smallest hash of the bucket that is being split."""

    source: str | None
    size: int
    target: float
    base: int
    budget: float
    low: int = 0
    threshold: int | None = None


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Water-filling: ``share`` of all sizes by weight; no target above ``most`` times its size, the excess reshared."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, open_ = share * sum(sizes.values()), {}, dict(weight)
    while open_:
        rest, heft = total - sum(full.values()), sum(open_.values())
        over = [s for s, w in open_.items() if rest * w / heft >= most * sizes[s]]
        if not over:
            return full | {s: rest * w / heft for s, w in open_.items()}
        for s in over:
            full[s] = most * sizes[s]
            del open_[s]
    return full


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, source_size, target, base, threshold)``: every document is taken ``base`` times, those below the threshold once more.

    One row per source reaches the driver; rows per document never do.
    """
    spark = docs.sparkSession
    narrow = materialise(
        docs.select(
            docs["source"].alias("source"),
            document_hash(docs["doc_id"], docs["text"]).alias("hash"),
            word_count(docs["text"]).alias("size"),
        ),
        "mix",
    )
    sizes = {r["source"]: int(r["size"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = source_targets(sizes, weights, share, most)
    shares = []
    for source, size in sizes.items():
        base = int(targets[source] // size) if size else 0
        one = _Share(source, size, targets[source], base, targets[source] - base * size)
        if one.budget <= 0:
            one.threshold = 0
        shares.append(one)
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        _refine(narrow, [s for s in shares if s.threshold is None], shift)
    rows = [(s.source, s.size, float(s.target), s.base, s.threshold if s.threshold is not None else 1 << HASH_BITS) for s in shares]
    return spark.createDataFrame(rows, _PLAN)


def _refine(narrow: DataFrame, shares: list[_Share], shift: int) -> None:
    """One histogram: of each source, only the bucket of hashes in which its budget ends."""
    if not shares:
        return
    spark = narrow.sparkSession
    held = spark.createDataFrame(
        [(i, s.source, s.low, float(s.budget)) for i, s in enumerate(shares)], "place int, owner string, low long, budget double"
    )
    inside = F.col("source").eqNullSafe(F.col("owner")) & (
        F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)
    )
    counted = (
        narrow.join(F.broadcast(held) if len(shares) <= 10_000 else held, inside)
        .groupBy("place", "budget", F.shiftright("hash", shift).alias("bucket"))
        .agg(F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("last"))
    )
    # At most 2^LEVEL_BITS rows per source.
    running = Window.partitionBy("place").orderBy("bucket")
    summed = counted.withColumn("through", F.sum("size").over(running))
    ends = (
        summed.filter(F.col("through") > F.col("budget"))
        .groupBy("place")
        .agg(F.min_by(F.struct("bucket", "size", "through", "least", "last"), "bucket").alias("end"))
    )
    ended = ends.collect()
    for row in ended:
        one, end = shares[row["place"]], row["end"]
        one.budget -= end["through"] - end["size"]
        if end["least"] == end["last"]:
            one.threshold = end["least"] + (2 * one.budget >= end["size"])
        else:
            one.low = end["bucket"] << shift
    for place in set(range(len(shares))) - {row["place"] for row in ended}:
        shares[place].threshold = 1 << HASH_BITS


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(row, size, source_size, target, times, taken)`` for every row of ``docs`` (with doc_id, text and source).

    ``size`` is the number of words (null text: 0). The sources in code-point order, null last, get ``weights`` in turn
    and share ``share`` of all words; a target stops at ``most`` times its source's size. ``times`` says how often the
    mix takes the document and ``taken`` is that many times its size. A source's taken words miss its target by at most
    half the document at the threshold. Rows equal in id and text share a hash and stand or fall together. An empty
    table gives an empty result; further columns stay inside ``row``. The result depends on the rows alone.
    """
    plan = plan_mix(docs, weights, share, most).withColumnRenamed("source", "owner")
    rows = packed(
        docs,
        size=word_count(docs["text"]),
        source=docs["source"],
        hash=document_hash(docs["doc_id"], docs["text"]),
    )
    times = F.col("base") + (F.col("hash") < F.col("threshold")).cast("int")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("owner"))).select(
        "row", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = mix_sources(docs, **settings).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return rows.select("row.*")
