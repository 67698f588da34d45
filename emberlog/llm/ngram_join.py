"""Exact n-gram Jaccard join by PartEnum signatures.

A document is its set of hashed five-word shingles. Sets are compared in size bands: band ``b`` takes the sizes from
``2^b`` to ``2^(b+1) - 1``, and a set whose larger partners may lie in the next band joins that one too. In a band the
feature domain is cut into ``P`` parts by hash, and a signature is the exact content of one non-empty part.

*Why no link is lost.* Two sets of sizes a and b with a similarity of 3/4 or more differ in at most ``(a + b) / 7``
features, so in at most ``d`` for the largest partner a set can have in the band. Each differing feature spoils one part.
A set with more than ``d`` non-empty parts therefore shares a signature with every partner, and, by the prefix argument,
one of the first ``d + 1`` signatures of either set in any order that all sets use alike; the rest need not be
enumerated. A set with ``d`` non-empty parts or fewer enumerates all of them and goes on to twice as many parts, up to
one part per feature; a partner was met before if it had enough parts itself, and goes on as well if it had not.

The order puts parts with many features first, and parts made only of widespread shingles last, so that passages which
many documents share do not make signatures while there are others. Any order is correct; this one is cheap.

*From signatures to links.* Equal sets are one node. Each group of equal signatures is cut into classes of like size
(within a factor of 4/3); every node is compared with the first of its class and the first of the class below; the true
links make components. In a group of at most ``SMALL`` nodes all pairs in different components are compared too. The
sets of larger groups that still have several components meet once more, by single shingles, rarest first (see
``_rare_features``), and so are their pairs. So large groups of copies cost a comparison or two a member and not all
pairs, and neither do large groups that only share a passage. A pair is compared by 256 counts of features first, whose
differences are a lower bound of the sets' difference, and by the texts if that does not rule the link out.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import WORD, Scratch, looked_up, packed, ready
from emberlog.llm.graph import labels_nearby, smallest_in_component
from emberlog.session import materialise

SHINGLE_WORDS = 5
#: Similarity of a link in percent; fixed value.
SIMILAR = 75

#: Features a part holds on average in the smallest set of a band; in the largest it holds twice as many.
LOAD = 1.25
#: Doublings of the number of parts before every feature is a part of its own.
LEVELS = 6

#: A shingle is widespread if this share of the documents has it. At most MOST_WIDESPREAD of them, the commonest, count
#: as such; that bounds what is broadcast (8 bytes each) and changes no result.
WIDESPREAD_SHARE = 1 / 5_000
MOST_WIDESPREAD = 1 << 18

#: Nodes of a group whose pairs in different components are all compared: a few for each member.
SMALL = 8

#: Rounds in which each set is compared with one drawn set per rare shingle, before all that are still apart.
DRAWS = 3

#: Cells of the feature counts that are compared before the texts.
CELLS = 256

#: Bytes of a text that are hashed at once.
_PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte of a word; blanks count nothing.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_BLANK] = 0
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


class _Powers:
    """Powers of ``_ODD`` and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x)]) for x in (_ODD, _ODD_INVERSE))


_POWERS = _Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial over its bytes, mixed. Works in pieces cut at blanks."""
    data, made, start = np.frombuffer(text, np.uint8), [], 0
    while start < len(data):
        end = start + _PIECE
        while end < len(data):
            gap = np.flatnonzero(_BLANK[data[end : end + _PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end += _PIECE
        piece = data[start:end]
        inside = ~_BLANK[piece]
        inside[1:] &= ~inside[:-1]
        first = np.flatnonzero(inside)
        if len(first):
            _POWERS.reach(len(piece))
            sums = np.add.reduceat(_BYTES[piece] * _POWERS.up[: len(piece)], first)
            made.append(_mixed(sums * _POWERS.down[first]))
        start = end
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def shingles(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes; a shorter text is one shingle; none without words. A-Z count as a-z."""
    hashes = word_hashes((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower())
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, SHINGLE_WORDS)
    total = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        total = total * _ODD + hashes[i : n - width + 1 + i]
    total = _mixed(total)
    total.sort()
    return total[_changes(total)]


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; true at the first."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _set_key(features: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(features.tobytes()) - (1 << 63)


def _node(key: str, n: str) -> Column:
    """The name of the node of a set."""
    return F.xxhash64(key, n)


def _bands(n: int) -> list[tuple[int, int]]:
    """``(band, d)``: where a set of ``n`` features is compared, and how many features may differ there at most."""
    band = n.bit_length() - 1
    top = (2 << band) - 1
    largest = 4 * n // 3
    found = [(band, (n + min(largest, top)) // 7)]
    if largest > top:
        found.append((band + 1, (n + largest) // 7))
    return found


def signatures(features: np.ndarray, widespread: np.ndarray) -> np.ndarray:
    """All signatures of a set, as 64-bit hashes."""
    n = len(features)
    common = None
    if len(widespread):
        places = np.minimum(np.searchsorted(widespread, features), len(widespread) - 1)
        common = widespread[places] == features
        common = common.astype(np.int64) if common.any() else None
    content = _mixed(features + _ODD)
    found = []
    for band, d in _bands(n):
        for level in range(LEVELS + 1):
            if level < LEVELS:
                # The hash range in equal parts: sorted features lie in sorted parts.
                parts = max(1, round((1 << band) / LOAD)) << level
                part = ((features >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            else:
                part = features
            starts = np.flatnonzero(_changes(part))
            sums = np.add.reduceat(content, starts)
            made = _mixed(sums + part[starts] * _ODD + np.uint64(band * 64 + level))
            if len(made) > d:
                sizes = np.empty(len(starts), np.int64)
                np.subtract(starts[1:], starts[:-1], out=sizes[:-1])
                sizes[-1] = n - starts[-1]
                # The order of the signatures: widespread content last, large parts first, then by hash.
                turn = (np.uint64(127) - np.minimum(sizes, 127).astype(np.uint64)) << np.uint64(56)
                turn |= made >> np.uint64(8)
                if common is not None:
                    turn |= (np.add.reduceat(common, starts) == sizes).astype(np.uint64) << np.uint64(63)
                found.append(made[np.argpartition(turn, d)[: d + 1]])
                break
            found.append(made)
    return np.concatenate(found)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def cell_counts(features: np.ndarray) -> bytes:
    """Features by cell. Cut off at 255, which keeps the differences a lower bound."""
    counts = np.bincount((features >> np.uint64(24)).astype(np.int64) % CELLS, minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


_PROFILE = "tag int, doc_id long, key long, n long, place long, cells binary"
_PROFILE_ARROW = pa.schema([("tag", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "key", "n", "place")), ("cells", pa.binary())])
_DOCUMENT, _COUNT = 0, 1


def _profiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's key, size and cell counts (tag 0), and of each shingle that is frequent here its count (tag 1).

    A worker counts shingles in rounds of about four million and hands on those with three documents of the round; what
    is rarer in every round is not widespread.
    """
    held: list[np.ndarray] = []
    waiting = 0

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 3
        values, counts = _signed(values[often]), counts[often]
        empty = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(values), _COUNT, np.int32)), empty, pa.array(values), pa.array(counts), empty, pa.nulls(len(values), pa.binary())],
            schema=_PROFILE_ARROW,
        )

    for batch in rows:
        sets = [shingles(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(sets), _DOCUMENT, np.int32)),
                batch.column(0),
                pa.array([_set_key(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                batch.column(2),
                pa.array([cell_counts(s) if len(s) else None for s in sets], pa.binary()),
            ],
            schema=_PROFILE_ARROW,
        )
        held += [s for s in sets if len(s)]
        waiting += sum(map(len, sets))
        if waiting > 4_000_000:
            yield counted()
            held, waiting = [], 0
    if held:
        yield counted()


def _signature_rows(widespread) -> callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = widespread.value, set()
        for batch in rows:
            made, keys, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                features = shingles(text)
                if not len(features):
                    continue
                key = _set_key(features)
                if (key, len(features)) in seen:  # a copy of a text this worker had
                    continue
                if len(seen) < 1_000_000:
                    seen.add((key, len(features)))
                own = signatures(features, common)
                made.append(own)
                keys.append(np.full(len(own), key))
                sizes.append(np.full(len(own), len(features), np.int32))
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(made))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))],
                    names=["sig", "key", "n"],
                )

    return run


_PAIR = "a_key long, a_n long, b_key long, b_n long, shared long"
_PAIR_ARROW = pa.schema([(c, pa.int64()) for c in ("a_key", "a_n", "b_key", "b_n", "shared")])


def _compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of shared shingles of each pair; the sets of recent texts are kept."""
    recent: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def features(key: int, n: int, text: str) -> np.ndarray:
        if (key, n) not in recent:
            recent[key, n] = shingles(text)
            if len(recent) > 64:
                recent.popitem(last=False)
        recent.move_to_end((key, n))
        return recent[key, n]

    for batch in rows:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        shared = [
            len(np.intersect1d(features(a, an, at), features(b, bn, bt), assume_unique=True)) for a, an, b, bn, at, bt in zip(*columns)
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], schema=_PAIR_ARROW)


def _cell_differences(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5))
        differ = np.abs(a - b).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(differ)], schema=_PAIR_ARROW)


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The pairs with this column of ``table`` (key, n) for either side."""

    def side(name: str) -> DataFrame:
        return table.select(F.col("key").alias(f"{name}_key"), F.col("n").alias(f"{name}_n"), F.col(column).alias(f"{name}_{column}"))

    joined = pairs.join(side("b"), ["b_key", "b_n"]).join(side("a"), ["a_key", "a_n"])
    return joined.select("a_key", "a_n", "b_key", "b_n", f"a_{column}", f"b_{column}")


def _likely(pairs: DataFrame, cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs that ``cells`` (key, n, cells) do not rule out."""
    # Here ``shared`` holds the least difference; similar sets differ in a seventh of their sizes' sum at most.
    rough = _both(pairs, cells, "cells").mapInArrow(_cell_differences, _PAIR)
    return scratch.write(rough.filter(7 * F.col("shared") <= F.col("a_n") + F.col("b_n")).drop("shared"), "rough-pairs")


def _confirmed(likely: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links as edges between nodes: those of the pairs that are linked by their ``texts`` (key, n, text)."""
    exact = _both(likely, texts, "text").mapInArrow(_compared, _PAIR)
    linked = exact.filter(100 * F.col("shared") >= SIMILAR * (F.col("a_n") + F.col("b_n") - F.col("shared")))
    found = scratch.write(linked.select(_node("a_key", "a_n").alias("u"), _node("b_key", "b_n").alias("v")), "links")
    scratch.spent(likely)
    return found


#: Shingles are counted by bucket of their hash, for their order only: the table is of this size whatever the input.
BUCKETS = 1 << 20


def _buckets(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bucket_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in rows:
        for text in batch.column(0).to_pylist():
            np.add.at(total, _buckets(shingles(text)), 1)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "held"])


def _rare_rows(held, similar: int) -> callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for key, n, part, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                features = shingles(text)
                order = np.lexsort((features, held.value[_buckets(features)]))[: n - (similar * n + 99) // 100 + 1]
                same = [pa.array(np.full(len(order), x, np.int64)) for x in (key, n, part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(features[order])), *same, pa.array(np.arange(1, len(order) + 1))],
                    names=["feature", "key", "n", "part", "place"],
                )

    return run


def _rare_features(sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``(feature, key, n, part, place)``: the shingles of ``sets`` (key, n, part, text) that a link may be met by.

    Shingles are ordered by how many of these sets have one of their bucket. The first one that two linked sets share
    stands early in both (in the first quarter for a similarity of 75 %), so that enough are left for the overlap of a
    link; any common order will do.
    """
    counts = sets.select("text").mapInArrow(_bucket_counts, "bucket int, held long").groupBy("bucket").agg(F.sum("held").alias("held"))
    counted = counts.toArrow()
    held = np.zeros(BUCKETS, np.int64)
    held[counted["bucket"].to_numpy()] = counted["held"].to_numpy()
    held = sets.sparkSession.sparkContext.broadcast(np.minimum(held, np.iinfo(np.int32).max).astype(np.int32))
    rows = sets.select("key", "n", "part", "text").mapInArrow(_rare_rows(held, similar), "feature long, key long, n long, part long, place long")
    # What only one set has meets nothing.
    shared = rows.withColumn("copies", F.count("*").over(Window.partitionBy("feature"))).filter("copies > 1").drop("copies")
    return materialise(shared, "rare-features")


def _met(a: DataFrame, b: DataFrame, similar: int, *, once: Column) -> DataFrame:
    """The distinct pairs of rows with one feature that may be linked, from different parts, the smaller set first."""
    a, b = (t.select("feature", *(F.col(c).alias(f"{x}_{c}") for c in t.columns if c != "feature")) for x, t in (("a", a), ("b", b)))
    left = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) + 1
    close = (F.col("a_part") != F.col("b_part")) & once & ((100 + similar) * left >= similar * (F.col("a_n") + F.col("b_n")))
    x, y = (F.struct(F.col(f"{s}_n").alias("n"), F.col(f"{s}_key").alias("key")) for s in "ab")
    small, large = F.least(x, y), F.greatest(x, y)
    return a.join(b, "feature").filter(close).select(
        small["key"].alias("a_key"), small["n"].alias("a_n"), large["key"].alias("b_key"), large["n"].alias("b_n")
    ).distinct()


def _star_pairs(early: DataFrame, draw: int, similar: int = SIMILAR) -> DataFrame:
    """Each set beside one, drawn by hash and anew for each ``draw``, of those that have a feature too."""
    drawn = F.min_by(F.struct("key", "n", "part", "place"), F.struct(F.xxhash64(F.lit(draw), "feature", "key", "n"), "key", "n"))
    hubs = early.groupBy("feature").agg(drawn.alias("hub"), F.min("part").alias("low"), F.max("part").alias("high"))
    return _met(early, hubs.filter("low < high").select("feature", "hub.*"), similar, once=F.lit(True))


def _rare_pairs(early: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """All pairs of different parts that share one of the features: one of the two is outside the feature's commonest part."""
    by_part = early.groupBy("feature", "part").agg(F.count("*").alias("held")).groupBy("feature")
    usual = by_part.agg(F.max_by("part", F.struct("held", "part")).alias("usual"), F.count("*").alias("parts")).filter("parts > 1")
    early = early.join(usual.drop("parts"), "feature")
    once = (F.col("b_part") == F.col("b_usual")) | (F.struct("a_n", "a_key") < F.struct("b_n", "b_key"))
    return _met(early.filter("part <> usual"), early, similar, once=once)


def _small_group_pairs(split: DataFrame) -> DataFrame:
    """All pairs from different parts of the groups ``split`` (sig, key, n, part) of few members, the smaller set first."""
    sets = split.filter(F.col("sig.members") <= SMALL).groupBy("sig").agg(F.collect_list(F.struct("n", "key", "part")).alias("sets"))
    pairs = sets.select("sets", F.explode("sets").alias("a")).select("a", F.explode("sets").alias("b"))
    once = F.struct("a.n", "a.key") < F.struct("b.n", "b.key")
    pairs = pairs.filter((F.col("a.part") != F.col("b.part")) & once & (4 * F.col("a.n") >= 3 * F.col("b.n")))
    return pairs.select(F.col("a.key").alias("a_key"), F.col("a.n").alias("a_n"), F.col("b.key").alias("b_key"), F.col("b.n").alias("b_n")).distinct()


def _linked(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, n, part, component)``, one row per row of ``docs``.

    ``place`` is the text's hash, ``part`` tells the components apart and ``component`` is the smallest doc_id in one.
    """
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark)
    plain = docs.select("doc_id", "text", F.xxhash64("text").alias("place"))
    profiles = scratch.write(plain.mapInArrow(_profiles, _PROFILE), "shingle-profiles")
    documents = profiles.filter(F.col("tag") == _DOCUMENT)

    least = max(16, int(documents.count() * WIDESPREAD_SHARE))
    often = profiles.filter(F.col("tag") == _COUNT).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    widest = [r["key"] for r in often.orderBy(F.desc("n"), "key").limit(MOST_WIDESPREAD).collect()]
    widespread = spark.sparkContext.broadcast(np.sort(np.array(widest, np.int64).view(np.uint64)))

    nodes = (
        documents.filter("n > 0")
        .groupBy("key", "n")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min_by("place", F.struct("doc_id", "place")).alias("place"),
            F.first("cells").alias("cells"),
        )
        .withColumn("node", _node("key", "n"))
    )
    nodes = scratch.write(nodes, "shingle-sets")

    # Groups of equal signatures; each member beside the first of its size class and the first of the class below.
    rows = docs.select("text").mapInArrow(_signature_rows(widespread), "sig long, key long, n int")
    # Most signatures occur once: they go before members are put in order.
    rows = rows.withColumn("copies", F.count("*").over(Window.partitionBy("sig"))).filter("copies > 1")
    rows = rows.withColumn("size_class", F.floor(F.log("n") / math.log(4 / 3)).cast("int"))
    whole = Window.partitionBy("sig")
    group = whole.orderBy("size_class", "n", "key")
    alike = Window.partitionBy("sig", "size_class").orderBy("n", "key")
    near = rows.withColumn("prev_n", F.lag("n").over(group)).withColumn("prev_key", F.lag("key").over(group))
    near = near.filter(~(F.col("prev_n").eqNullSafe(F.col("n")) & F.col("prev_key").eqNullSafe(F.col("key"))))
    near = near.withColumn("hub", F.first(F.struct("n", "key")).over(alike)).withColumn("before", F.lag("hub").over(group))
    near = near.select(
        "size_class", "key", F.col("n").cast("long"), "hub", F.first(F.struct("before")).over(alike)["before"].alias("below"),
        F.count("*").over(whole).alias("members"),
        F.expr("bit_xor(xxhash64(n, key))").over(whole).alias("mark"), F.expr("bit_xor(xxhash64(key, n))").over(whole).alias("mark2"),
    ).filter("members > 1")
    # Signatures with the same members ask for the same comparisons: such groups become one, named by its members.
    groups = scratch.write(
        near.groupBy(F.struct("members", "mark", "mark2").alias("sig"), "size_class", "key", "n").agg(
            F.first("hub.key").alias("hub_key"), F.first("hub.n").cast("long").alias("hub_n"),
            F.first("below.key").alias("below_key"), F.first("below.n").cast("long").alias("below_n"),
        ),
        "signature-groups",
    )

    del rows, near
    scratch.free_shuffles()

    def pairs_with(key: str, n: str) -> DataFrame:
        other = groups.filter(F.col(n).isNotNull() & ~((F.col(key) == F.col("key")) & (F.col(n) == F.col("n"))))
        return other.filter(4 * F.col(n) >= 3 * F.col("n")).select(
            F.col(key).alias("a_key"), F.col(n).alias("a_n"), F.col("key").alias("b_key"), F.col("n").alias("b_n")
        )

    first = scratch.write(pairs_with("hub_key", "hub_n").union(pairs_with("below_key", "below_n")).distinct(), "pairs")
    # The texts of the sets that share a signature with another; others are not shuffled. Repeated rows meet in one place.
    mark = F.xxhash64("doc_id", "place").alias("mark")
    wanted = groups.select("key", "n").distinct().join(nodes.withColumnRenamed("least_id", "doc_id"), ["key", "n"])
    wanted = scratch.write(wanted.select("key", "n", mark), "wanted-texts")
    found = looked_up(plain.select("text", mark), wanted.select("mark"), "mark").join(wanted, "mark")
    found = found.groupBy("mark").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first("text").alias("text"))
    texts = scratch.write(found.drop("mark"), "candidate-texts")
    scratch.spent(wanted)
    del found
    scratch.free_shuffles()

    pair = ["a_key", "a_n", "b_key", "b_n"]
    edges = _confirmed(_likely(first, nodes, scratch), texts, scratch)
    scratch.free_shuffles()

    def labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
        """``sets`` with a name for each, the same only within a component: it saves comparisons, so a near one will do."""
        known = sets.withColumn("id", _node("key", "n")).join(labels, "id", "left")
        return known.withColumn("part", F.coalesce("label", "id")).drop("id", "label")

    # Sets of groups whose members are still in different components: small groups give all pairs. Sets of others meet once
    # more, by their rarest shingles: each beside one set that has the shingle too, a few times with another one, then
    # whatever is in different components still.
    labels = scratch.write(labels_nearby(edges), "labels")
    split = labelled(groups.select("sig", "key", "n"), labels)
    small = scratch.write(_small_group_pairs(split).join(first, pair, "left_anti"), "small-group-pairs")
    large = split.filter(F.col("sig.members") > SMALL)
    apart = large.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("sig")
    still = scratch.write(large.join(apart, "sig", "left_semi").select("key", "n", "part").distinct(), "open-sets")
    scratch.spent(labels, groups)
    asked, second = first, small
    if still.count():
        some = looked_up(texts, still.select("key"), "key").join(nodes.select("key", "n", "cells"), ["key", "n"])
        open_texts = scratch.write(still.join(some, ["key", "n"]), "open-texts")
        del some
        scratch.free_shuffles()
        early = _rare_features(open_texts)
        for draw in range(DRAWS):
            stars = scratch.write(_star_pairs(early, draw).join(asked, pair, "left_anti"), "star-pairs")
            asked, edges = asked.union(stars), edges.union(_confirmed(_likely(stars, open_texts, scratch), open_texts, scratch))
            labels = scratch.write(labels_nearby(edges), "labels")
            early = labelled(early.drop("part"), labels)
            # A shingle whose sets are all in one component asks for nothing more.
            ends = early.groupBy("feature").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
            early = materialise(early.join(ends.select("feature"), "feature", "left_semi"), "rare-features")
            scratch.spent(labels)
            scratch.free_shuffles()
            if not early.count():
                break
        second = _rare_pairs(early).union(small).distinct().join(asked, pair, "left_anti")
        scratch.spent(open_texts)
    likely = _likely(second, nodes, scratch)
    compared = likely.select(F.col("a_key").alias("key")).union(likely.select("b_key"))
    edges = edges.union(_confirmed(likely, looked_up(texts, compared, "key"), scratch))
    scratch.spent(texts)
    scratch.free_shuffles()
    parts = smallest_in_component(edges, scratch)

    labels = nodes.join(parts, F.col("id") == F.col("node"), "left").select("key", "n", "least_id", F.coalesce("component", "node").alias("part"))
    # Components have names of their own, as rows with one doc_id may have different texts, or no doc_id at all.
    ids = labels.groupBy("part").agg(F.min("least_id").alias("component"))
    labels = labels.drop("least_id").join(ids, "part")
    return documents.select("doc_id", "place", "key", "n").join(labels, ["key", "n"], "left").drop("key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links (itself included). Only as many links are tested as it
    takes to know the components, so links are not counted. A text without words, or null, has no shingles and no links.
    Repeated rows give repeated rows. A null doc_id takes part; a component of such rows alone has a null id. An empty
    table gives an empty result; further columns are left out.
    """
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return _linked(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, null last; of several texts with that id, or rows with
    that id and text, one by hash.

    Texts without words are linked with nothing and stay, every row of them.
    """
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    kept = _linked(docs).filter("n > 0").groupBy("part").agg(F.min_by(F.xxhash64("doc_id", "place"), first).alias("kept"))
    hashable = [docs[f"`{name}`"] for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    mark = F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"]))
    rows = packed(docs, mark=mark, turn=F.xxhash64(*hashable), worded=F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(WORD))
    # Repeated rows become one before they are dealt out.
    single = rows.filter("worded").groupBy("mark").agg(F.min_by("row", "turn").alias("row"))
    worded = single.join(kept, F.col("mark") == F.col("kept"), "left_semi").select("row")
    return worded.union(rows.filter("NOT worded").select("row")).select("row.*")
