"""Packing documents into training sequences of several permitted lengths.

Longest first, a piece goes into the open bin with the least room that holds it. If none does, a bin is opened, and its
length is chosen by cost: for every permitted length the pieces that are still to come are tried on for size, and the
length with the least cost per token it would hold wins. At last each bin shrinks to the least permitted length that
holds its contents.

The documents are dealt into shards of about :data:`SHARD_TOKENS` tokens by hash, and each shard is packed on its own by
one task, so memory and work per task are bounded at any size. A shard of that size leaves next to no bin half empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ready, word_count
from emberlog.session import materialise

LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length: padding and bookkeeping of one row of a batch.
ROW_COST = 16

SHARD_TOKENS = 4_000_000


class _Room:
    """Sizes with counts, in order; finds the largest that fits and the least that holds."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.held: dict[int, list] = {}

    def put(self, size: int, what) -> None:
        if size not in self.held:
            insort(self.sizes, size)
            self.held[size] = []
        self.held[size].append(what)

    def take(self, size: int):
        found = self.held[size].pop()
        if not self.held[size]:
            del self.held[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return found

    def least_from(self, size: int) -> int | None:
        at = bisect_left(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else None


def _filled(counts: dict[int, int], sizes: list[int], upto: int, room: int) -> int:
    """How much of ``room`` the pieces still to come would fill, the largest that fits first.

    ``sizes`` is ascending, and only its first ``upto`` are still to come.
    """
    left = room
    while left > 0:
        at = bisect_left(sizes, left + 1, 0, upto) - 1
        if at < 0:
            break
        size = sizes[at]
        left -= size * min(counts[size], left // size)
        upto = at
    return room - left


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, row_cost: int = ROW_COST) -> tuple[list[int], list[int], list[int]]:
    """``(bin of each piece, offset of each piece, length of each bin)``. No size may exceed the largest length.

    Pieces of size 0 go into the bin that is open last (or one of the least length) and take no room.
    """
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    counts: dict[int, int] = {}
    for size in sizes:
        counts[size] = counts.get(size, 0) + 1
    rising = sorted(size for size in counts if size)
    in_bin, offset, capacity, used = [0] * len(sizes), [0] * len(sizes), [], []
    room = _Room()
    for i in order:
        size = sizes[i]
        counts[size] -= 1
        if size > lengths[-1]:
            raise ValueError(f"a piece of {size} is longer than the longest sequence")
        space = room.least_from(max(size, 1))
        if space is None:
            upto = bisect_left(rising, size + 1)
            best = None
            for length in lengths:
                if length >= size:
                    held = size + _filled(counts, rising, upto, length - size)
                    cost = (length + row_cost) / max(held, 1)
                    if best is None or cost < best[0]:
                        best = (cost, length)
            own, space = len(capacity), best[1]
            capacity.append(space)
            used.append(0)
        else:
            own = room.take(space)
        in_bin[i], offset[i] = own, used[own]
        used[own] += size
        if space > size:
            room.put(space - size, own)
    return in_bin, offset, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """``(doc_id, mark, piece, start, n_tokens)``: documents in stretches of at most ``longest`` tokens.

    A token is a word. ``mark`` tells texts with the same doc_id apart.
    """
    sized = docs.select(docs["doc_id"], F.xxhash64(docs["doc_id"], docs["text"]).alias("mark"), word_count(docs["text"]).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / longest).cast("int") - 1, F.lit(0))
    cut = sized.select("doc_id", "mark", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut.select("doc_id", "mark", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).alias("n_tokens"))


_PACKED = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_length long, bin_offset long, bin_used long"


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, row_cost: int = ROW_COST) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset, bin_used)``, every token of ``docs`` once.

    Documents longer than the longest length are cut into full sequences and a rest. A null or empty text is one piece
    without tokens. ``bin_id`` is unique; ``bin_offset`` is the piece's place in the sequence. Repeated rows are packed
    each; an empty table gives none; further columns are left out. Reruns agree.
    """
    ready(docs.sparkSession)
    longest = max(lengths)
    cut = materialise(pieces(docs, longest), "pieces")
    total = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    # Empty pieces count as well: a shard is bounded in rows, too.
    shards = max(1, -(-total[0] // SHARD_TOKENS), -(-total[1] // (SHARD_TOKENS // 8)))
    # The number of a piece is part of the hash, so the pieces of one document, or of copies in one place, spread.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("mark", "piece"), F.lit(shards)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("mark", "ascending"), ("piece", "ascending")])
        in_bin, offset, length = pack(rows["n_tokens"].to_pylist(), lengths, row_cost)
        bins = np.array(in_bin)
        used = np.bincount(bins, weights=rows["n_tokens"].to_numpy()).astype(np.int64)
        first = rows["shard"][0].as_py() * SHARD_TOKENS * 2
        own = rows.select(["doc_id", "piece", "start", "n_tokens"])
        added = {"bin_id": first + bins, "bin_length": np.array(length)[bins], "bin_offset": np.array(offset), "bin_used": used[bins]}
        for name, values in added.items():
            own = own.append_column(name, pa.array(values.astype(np.int64)))
        return own

    return dealt.groupBy("shard").applyInArrow(run, _PACKED)


def packed_sequences(packing: DataFrame) -> DataFrame:
    """``(bin_id, bin_length, bin_used, n_pieces)``, one row per sequence."""
    return packing.groupBy("bin_id").agg(
        F.first("bin_length").alias("bin_length"), F.first("bin_used").alias("bin_used"), F.count("*").alias("n_pieces")
    )
