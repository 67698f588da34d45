"""Near duplicates by a chosen-path set similarity join.

A document is its set of hashed five-word shingles; equal sets are one. A set has ``POSITIONS`` minwise tokens: two sets
agree at a position with the probability of their Jaccard similarity.

*Trees.* A node of a tree draws, by its own name, the position at which its members branch; near the root also a second
one, with a probability that makes a pair at the threshold meet in one child on average. A child is a position together
with the token there. Nodes in which few sets are outside the largest component are compared exhaustively; others branch
again, by more tokens at each level. Sets without a partner are alone after the first token, and sets that only share a
passage part after a few. Independent trees, ``TREES`` of them, bring the recall of a pair at the threshold that has to
pass ``DEPTH`` tokens to ``RECALL``; pairs that are more alike, or in smaller nodes, are found almost surely.

*Large groups.* In a large node each member is compared with one drawn member, another one in each node; links make
components, a node with one component is done, and only members of different components are compared. A node with
``SMALL`` sets or fewer outside its largest component costs each member as many comparisons at most, whatever its size.
So thousands of near copies cost a few comparisons a member and not all pairs, while every link that joins two
components is looked for by the same rule.

*What stays crowded.* A node that is large and in several components after ``DEPTH`` tokens may part the members of a
link in all trees, or be large to the end. Its sets meet once more by their rarest shingles, which misses no link between
them: each beside drawn sets first, then all that are still in different components.

*Links* are confirmed on the full sets. Before that a pair's minwise tokens are compared: linked sets agree at fewer
than ``LEAST_AGREEING`` of them with a probability below 1e-5.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch, looked_up, ready
from emberlog.llm.graph import labels_nearby, smallest_in_component
from emberlog.llm.ngram_join import DRAWS, _cell_differences, _rare_features, _rare_pairs, _star_pairs, cell_counts, shingles

#: Similarity of a link in percent; fixed value.
SIMILAR = 85

#: Minwise tokens of a set, and how many of them a linked pair agrees at, at least (4.5 standard deviations less).
POSITIONS = 128
LEAST_AGREEING = math.floor(POSITIONS * SIMILAR / 100 - 4.5 * math.sqrt(POSITIONS * SIMILAR / 100 * (1 - SIMILAR / 100)))

#: Nodes with so many sets outside their largest component are compared exhaustively.
SMALL = 16
#: Tokens by which the nodes of a level branch, and up to which one there may be a second child.
STEPS = (1, 4, 9)
TWICE = 4
#: Recall of a pair at the threshold whose nodes stay large until so many tokens have been agreed on.
RECALL = 0.999
DEPTH = sum(STEPS[:2])
#: A second child, so that a pair at the threshold has one child in common on average.
SECOND_CHILD = 100 / SIMILAR - 1


def survival(tokens: int) -> float:
    """Probability that a pair at the threshold still shares a node of a tree after so many tokens."""
    alive, like = 1.0, SIMILAR / 100
    for token in range(tokens, 0, -1):
        second = SECOND_CHILD if token <= TWICE else 0
        alive = 1 - (1 - like * alive) * (1 - second * like * alive)
    return alive


TREES = math.ceil(math.log(1 - RECALL) / math.log(1 - survival(DEPTH)))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over 64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SHIFTS = _mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64) * _ODD)
_FACTORS = _mixed(_SHIFTS + _ODD) | np.uint64(1)
_ROOTS = _mixed(np.arange(1, TREES + 1, dtype=np.uint64) + np.uint64(1 << 32))


def minwise(features: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set: at each position the least of another hash of its features."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for start in range(0, len(features), 4096):
        hashed = (features[start : start + 4096, None] ^ _SHIFTS) * _FACTORS
        np.minimum(least, hashed.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def branch(nodes: np.ndarray, tokens: np.ndarray, first: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that the rows reach from theirs by so many tokens, after ``first`` of them, and the row of each."""
    rows = np.arange(len(nodes))
    for token in range(first + 1, first + steps + 1):
        drawn = _mixed(nodes ^ _ODD)
        position = (drawn % np.uint64(POSITIONS)).astype(np.int64)
        second = (position + 1 + ((drawn >> np.uint64(8)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
        twice = (drawn >> np.uint64(40)).astype(np.float64) < (SECOND_CHILD * (1 << 24) if token <= TWICE else 0)
        place = np.concatenate([position, second[twice]])
        rows, nodes = np.concatenate([rows, rows[twice]]), np.concatenate([nodes, nodes[twice]])
        nodes = _mixed(nodes + _ODD * (tokens[rows, place].astype(np.uint64) * np.uint64(POSITIONS) + place.astype(np.uint64) + np.uint64(1)))
    return nodes, rows


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


_PROFILE = "doc_id long, place long, key long, n long, tokens binary"
_PROFILE_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "place", "key", "n")), ("tokens", pa.binary())])
#: Texts whose sets a task remembers, by two hashes of the text.
_REMEMBERED = 200_000


def _profiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and size of each document's set; the tokens beside the first document a task has with it."""
    known: dict[bytes, tuple[int | None, int]] = {}
    for batch in rows:
        found = []
        for text in batch.column(2).to_pylist():
            mark = xxhash.xxh3_128_digest(text or b"")
            if mark in known:
                found.append((*known[mark], None))
                continue
            features = shingles(text)
            key = xxhash.xxh3_64_intdigest(features.tobytes()) - (1 << 63) if len(features) else None
            if len(known) >= _REMEMBERED:
                known.clear()
            known[mark] = (key, len(features))
            found.append((key, len(features), minwise(features).tobytes() if len(features) else None))
        keys, sizes, tokens = zip(*found) if found else ((), (), ())
        columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=_PROFILE_ARROW)


_ROW = "node long, key long, part long"
_ROW_ARROW = pa.schema([(c, pa.int64()) for c in ("node", "key", "part")])


def _node_rows(nodes: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(keys), pa.array(parts)], schema=_ROW_ARROW)


def _planted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each set (key, tokens) at the first level of all trees; at first a set is a component of its own."""
    for batch in rows:
        keys, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1))
        every = np.repeat(np.arange(len(keys)), TREES)
        nodes, of = branch(np.tile(_ROOTS, len(keys)), tokens[every], 0, STEPS[0])
        yield _node_rows(nodes, keys[every[of]], keys[every[of]])


def _grown(level: int) -> Callable:
    first, steps = sum(STEPS[:level]), STEPS[level]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of the next level of (node, key, part, tokens)."""
        for batch in rows:
            start, keys, parts = (batch.column(i).to_numpy() for i in range(3))
            nodes, of = branch(start.view(np.uint64), _tokens(batch.column(3)), first, steps)
            yield _node_rows(nodes, keys[of], parts[of])

    return run


_PAIR = "a long, b long"
_PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _likely(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that agree at enough positions."""
    for batch in rows:
        agree = (_tokens(batch.column(2)) == _tokens(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=_PAIR_ARROW).filter(pa.array(agree >= LEAST_AGREEING))


def _confirmed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked, by their full sets; the sets of recent texts are kept."""
    recent: OrderedDict[int, np.ndarray] = OrderedDict()

    def features(key: int, text: bytes) -> np.ndarray:
        if key not in recent:
            recent[key] = shingles(text)
            if len(recent) > 64:
                recent.popitem(last=False)
        recent.move_to_end(key)
        return recent[key]

    for batch in rows:
        linked = []
        for a, b, *texts in zip(*(column.to_pylist() for column in batch.columns)):
            x, y = features(a, texts[0]), features(b, texts[1])
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * shared >= SIMILAR * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=_PAIR_ARROW).filter(pa.array(linked, pa.bool_()))


def _beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with these columns of both keys, as ``a_…`` and ``b_…``."""
    for side in "ba":
        pairs = pairs.join(table.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def _live(rows: DataFrame, level: int) -> DataFrame:
    """``(node, key, part, usual, others, hub)``: the rows of nodes with several components, with the node's largest
    component, the number of its sets outside that, and a drawn set."""
    salt = F.xxhash64(F.lit(level), "node")
    parts = rows.groupBy("node", "part").agg(F.count("*").alias("held"), F.min(F.col("key").bitwiseXOR(salt)).alias("drawn"))
    nodes = parts.groupBy("node").agg(
        F.max_by("part", F.struct("held", "part")).alias("usual"),
        (F.sum("held") - F.max("held")).alias("others"),
        F.min("drawn").bitwiseXOR(salt).alias("hub"),
    )
    return rows.join(nodes.filter("others > 0"), "node")


def _met(live: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, that the nodes ask to compare."""
    small = live.filter(F.col("others") <= SMALL).select("node", "key", "part", "usual")
    other = small.filter("part <> usual").select("node", F.col("key").alias("key2"), F.col("part").alias("part2"))
    # Two sets outside the largest component meet once.
    every = small.join(other, "node").filter("part <> part2 AND (part = usual OR key < key2)")
    star = live.filter((F.col("others") > SMALL) & (F.col("key") != F.col("hub"))).select("key", F.col("hub").alias("key2"))
    return every.select("key", "key2").union(star).select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def _celled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature counts by cell of the sets (key, text)."""
    for batch in rows:
        cells = [cell_counts(shingles(text)) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["key", "cells"])


def _labelled(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, part)`` of the sets that are linked: the same part only within a component."""
    # Labels only save comparisons, so near ones will do until the end.
    nearby = labels_nearby(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return scratch.write(nearby.select(F.col("id").alias("key"), F.col("label").alias("part")), "labels")


def _in_several(rows: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """The rows (with a key), their part by these labels, of those groups by ``name`` that have several."""
    rows = rows.join(labels, "key", "left").withColumn("part", F.coalesce("part", "key"))
    ends = rows.groupBy(name).agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return rows.join(ends.filter("low < high").select(name), name, "left_semi")


def _crowded_links(crowded: DataFrame, known: DataFrame, texts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` and those between sets of the crowded nodes (node, key) that are in different components without them."""
    labels = _labelled(links, scratch)
    still = _in_several(crowded, "node", labels).select("key", "part").distinct().join(known.select("key", "n"), "key")
    still = scratch.write(still.join(texts, "key").select("key", "n", "part", "text"), "crowded-texts")
    scratch.spent(labels)
    if not still.count():
        scratch.spent(still)
        return links
    early = _rare_features(still, SIMILAR)
    cells = scratch.write(still.select("key", "text").mapInArrow(_celled, "key long, cells binary"), "set-cells")
    asked = None
    for draw in range(DRAWS + 1):
        met = _star_pairs(early, draw, SIMILAR) if draw < DRAWS else _rare_pairs(early, SIMILAR)
        met = met.filter(100 * F.least("a_n", "b_n") >= SIMILAR * F.greatest("a_n", "b_n"))
        met = scratch.write(met if asked is None else met.join(asked, ["a_key", "b_key"], "left_anti"), "crowded-pairs")
        beside = _beside(met.select(F.col("a_key").alias("a"), "a_n", F.col("b_key").alias("b"), "b_n"), cells, "cells")
        differ = beside.select("a", "a_n", "b", "b_n", "a_cells", "b_cells").mapInArrow(
            _cell_differences, "a_key long, a_n long, b_key long, b_n long, shared long"
        )
        # ``shared`` holds the least difference of the sets, of which links have (100 - SIMILAR) / (100 + SIMILAR) at most.
        close = differ.filter((100 + SIMILAR) * F.col("shared") <= (100 - SIMILAR) * (F.col("a_n") + F.col("b_n")))
        close = scratch.write(close.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")), "likely-pairs")
        found = _beside(close, still, "text").select("a", "b", "a_text", "b_text").mapInArrow(_confirmed, _PAIR)
        before, links = links, scratch.write(found.union(links), "links")
        scratch.spent(close, before)
        if draw < DRAWS:
            asked = met.select("a_key", "b_key") if asked is None else asked.union(met.select("a_key", "b_key"))
            labels = _labelled(links, scratch)
            # A shingle whose sets are all in one component asks for nothing more.
            early = scratch.write(_in_several(early.drop("part"), "feature", labels), "rare-features")
            scratch.spent(labels)
    scratch.spent(still, cells)
    return links


def _texts(docs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, text)`` of these sets, the text as UTF-8."""
    wanted = sets.select("key", "place").join(keys, "key", "left_semi")
    rows = docs.select(F.xxhash64("text").alias("place"), docs["text"].cast("binary").alias("text"))
    found = looked_up(rows, wanted.select("place"), "place").groupBy("place").agg(F.first("text").alias("text"))
    return wanted.join(found, "place").select("key", "text")


def components(docs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of the sets (key, n, place, tokens) that are linked with another: the least key there."""
    known = sets.select("key", "n", "tokens")
    rows = scratch.write(sets.select("key", "tokens").mapInArrow(_planted, _ROW), "tree-nodes")
    texts = links = labels = crowded = None
    for level in range(len(STEPS)):
        live = scratch.write(_live(rows, level), "shared-nodes")
        scratch.spent(rows)
        sized = _beside(_met(live), known, "n", "tokens").filter(100 * F.least("a_n", "b_n") >= SIMILAR * F.greatest("a_n", "b_n"))
        likely = scratch.write(sized.select("a", "b", "a_tokens", "b_tokens").mapInArrow(_likely, _PAIR), "likely-pairs")
        large = live.filter(F.col("others") > SMALL)
        if texts is None:
            keys = likely.select(F.col("a").alias("key")).union(likely.select("b")).union(large.select("key")).distinct()
            texts = scratch.write(_texts(docs, sets, keys), "candidate-texts")
        found = _beside(likely, texts, "text").select("a", "b", "a_text", "b_text").mapInArrow(_confirmed, _PAIR)
        before, links = links, scratch.write(found if links is None else found.union(links), "links")
        scratch.spent(likely, *([] if before is None else [before]))
        if level + 1 == len(STEPS):
            scratch.spent(live)
            break

        # What is still large and in several components goes on.
        if labels is not None:
            scratch.spent(labels)
        labels = _labelled(links, scratch)
        large = _in_several(large.select("node", "key"), "node", labels)
        if sum(STEPS[: level + 1]) == DEPTH:
            crowded = scratch.write(large.select("node", "key"), "crowded-nodes")
        going = large.join(sets.select("key", "tokens"), "key").select("node", "key", "part", "tokens")
        rows = scratch.write(going.mapInArrow(_grown(level + 1), _ROW), "tree-nodes")
        scratch.spent(live)
        if not rows.count():
            scratch.spent(rows)
            break
    if crowded is not None:
        links = _crowded_links(crowded, known, texts, links, scratch)
        scratch.spent(crowded)
    found = smallest_in_component(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    scratch.spent(texts, links, *([] if labels is None else [labels]))
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links, itself included; ``kept`` says that it is the row's own.
    A text without words, or null, has no shingles and no links and is kept. Repeated rows give repeated rows. A null
    doc_id takes part in links; a component of such rows alone has a null id, and its rows are kept. An empty table
    gives an empty result; further columns, of any name, are left out. Sets are told apart by a 64-bit hash.
    """
    scratch = Scratch(ready(docs.sparkSession))
    profile = scratch.write(
        docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("place"), docs["text"].cast("binary")).mapInArrow(_profiles, _PROFILE), "set-profiles"
    )
    worded = profile.filter("n > 0")
    tokens = worded.filter("tokens IS NOT NULL").groupBy("key").agg(F.first("tokens").alias("tokens"))
    sets = worded.groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("least_id"), F.min("place").alias("place"))
    sets = scratch.write(sets.join(tokens, "key"), "minwise-sets")
    labels = components(docs.select("text"), sets, scratch)
    parts = sets.select("key", "least_id").join(labels, F.col("id") == F.col("key"), "left").withColumn("part", F.coalesce("component", "key"))
    ids = parts.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = scratch.write(parts.join(ids, "part").select("key", "component_id"), "set-components")
    scratch.spent(sets)
    found = profile.select("doc_id", "key", "n").join(named, "key", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
