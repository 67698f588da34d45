"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text, one for each language.

The vocabulary is open: every word of the trusted text counts, and the mass that the discounts leave goes to all other
words by the probability of their spelling under a trigram model of the bytes of the language's distinct words. So an
unseen word is never cheaper than a seen one of its kind, and letters that no word has are very dear.

For a bigram ``v w`` the model says ``(c(vw) - D) / c(v) + g(v) p(w)`` if it was seen, and ``g(v) p(w)`` if not. So a
document's log-probability is the sum of ``log g(v) + log p(w)`` over its words and of a gain for each bigram that was
seen. A worker adds up by itself what the spelling gives and, from a copy of their rows, the commonest words and bigrams;
a bit table leaves out most unseen words and bigrams. What is left stays sharded by key: a chunk of documents asks each
bucket of keys once, by one compressed list of distinct keys and their documents, and gets one list of sums by document.
Bigrams of two commonest words are keyed by the words' ranks in the copy, which take five bytes less than a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch, power_of_two, ready
from emberlog.llm.ngram_join import _ODD, _ODD_INVERSE, _mixed, word_hashes

#: Words, and bigrams of them, whose rows every worker has a copy of. That bounds the copies and changes no result.
COMMONEST = 1 << 18
COMMONEST_PAIRS = 1 << 20
#: Words there might be in a language: a seen word gets this share of the discounts' mass beside its own.
_WIDTH = 1 << 40

#: Bits of the tables that leave out untrusted documents, unseen words and bigrams before a shuffle. Misses only cost work.
DOCUMENT_BITS = 1 << 22
SEEN_BITS = 8
MOST_SEEN_BITS = 1 << 28

#: Words of the trusted text for each bucket of keys, and the least number of buckets.
BUCKET_WORDS = 1 << 22
LEAST_BUCKETS = 64
#: Tasks that the buckets are dealt to: each returns a number for each document, so there are not as many as of rows.
LEAST_PARTS, MOST_PARTS = 32, 64
#: Gains are kept as whole numbers of this part of one.
_UNIT = 2.0**32

#: One in this many trusted documents is kept from training and sets the thresholds.
HELD_OUT = 5
#: Share of the held-out trusted documents of a language that a threshold accepts.
QUANTILE = 0.995
#: A language with fewer held-out documents is cross-fitted, so that all its trusted documents set the threshold.
ENOUGH_HELD_OUT = 50
#: The pooled quantile weighs as much as this many documents of the language.
POOLED_WEIGHT = 20

#: Words of a chunk of documents whose words and bigrams a worker sorts together, and of the trusted text.
CHUNK_WORDS = 3_000_000
TRAINING_WORDS = 2_000_000
#: Words and bigrams that a worker gathers before it deals them to the buckets, and documents whose sums it holds.
_DEALT = 1_000_000
_HELD = 1 << 23

_EDGE = 256
_SYMBOLS = 257


def _language_hash(lang: str | None, fold: int) -> int:
    """A language's model is told apart by the fold of the trusted documents it was not trained on; fold 0 judges."""
    return xxhash.xxh3_64_intdigest(lang or "", seed=fold + (1 << 32 if lang is None else 0))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(place: int, text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, told apart by language. Case is kept out."""
    return _mixed(word_hashes((text or b"").lower()) + np.uint64(place))


def _bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(v * _ODD + w)


_RANK = np.uint64(18)
_PAIR = np.uint64((1 << 36) - 1)


def _pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams by the ranks of their words: 36 bits, mixed so that the highest deal them evenly to buckets."""
    x = v.astype(np.uint64) << _RANK | w.astype(np.uint64)
    x = (x ^ x >> _RANK) * _ODD & _PAIR
    return (x ^ x >> _RANK) << np.uint64(28)


def _pair_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = keys >> np.uint64(28)
    x = (x ^ x >> _RANK) * _ODD_INVERSE & _PAIR
    x ^= x >> _RANK
    return (x >> _RANK).astype(np.int64), (x & np.uint64((1 << 18) - 1)).astype(np.int64)


def _last_keys(w: np.ndarray) -> np.ndarray:
    """Keys of words that end a text."""
    return _mixed(w ^ _ODD)


def _pressed(*columns: np.ndarray) -> bytes:
    """Columns of any lengths, compressed with bytes of the same weight side by side."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(np.array(list(map(len, columns)), np.int64).tobytes() + b"".join(planes), 1)


def _unpressed(data: bytes, *types: str) -> list[np.ndarray]:
    data, at, columns = zstandard.decompress(data), 8 * len(types), []
    for n, kind in zip(np.frombuffer(data, np.int64, len(types)).tolist(), map(np.dtype, types)):
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        columns.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return columns


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences; ``cumsum`` gives them back."""
    return np.diff(keys, prepend=np.zeros(1, np.uint64))


def _added_up(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys in order, a place of each, and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], order[starts], [np.add.reduceat(c[order], starts) if len(starts) else c[:0] for c in columns]


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of ascending keys starts, and the end. A bucket is told by the highest bits."""
    starts = np.arange(buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())
    return np.r_[np.searchsorted(keys, starts), len(keys)]


def _followers(place: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, v)`` of the bigram that ends at each word; the first follows the language's start."""
    v = np.r_[np.full(1, place, np.uint64), hashes[:-1]][: len(hashes)]
    return _bigram_keys(v, hashes), v


class Spelling:
    """Trigrams of bytes, interpolated by the number of distinct followers down to equal chances. A word ends at an edge."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        below = np.full(1, 1 / _SYMBOLS)
        self.levels = []
        for size in (1, _SYMBOLS, _SYMBOLS**2):
            own, at = np.unique(keys % (size * _SYMBOLS), return_inverse=True)
            held = np.bincount(at, counts, len(own))
            contexts, of = np.unique(own // _SYMBOLS, return_inverse=True)
            total, kinds = np.bincount(of, held), np.bincount(of).astype(float)
            rest = kinds / (total + kinds)
            lower = below if size == 1 else self._at(own % size, len(self.levels))
            self.levels.append((own, held / (total + kinds)[of] + rest[of] * lower, contexts, rest))

    def _at(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Probability of the last symbol of each key, by the first ``depth`` levels."""
        p = np.full(len(keys), 1 / _SYMBOLS)
        for level, (own, known, contexts, rest) in enumerate(self.levels[:depth]):
            key = keys % _SYMBOLS ** (level + 1)
            place = np.minimum(np.searchsorted(contexts, key // _SYMBOLS), len(contexts) - 1)
            p = np.where(contexts[place] == key // _SYMBOLS, p * rest[place], p)
            place = np.minimum(np.searchsorted(own, key), len(own) - 1)
            p = np.where(own[place] == key, known[place], p)
        return p

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        keys, starts = _trigrams(words)
        distinct, at = np.unique(keys, return_inverse=True)
        return np.add.reduceat(np.log(self._at(distinct, 3))[at], starts) if len(words) else np.zeros(0)


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that ends at each byte and at the end of each word, and where each word starts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    c = np.full(int(sizes.sum()), _EDGE, np.int64)
    inside = np.ones(len(c), bool)
    inside[ends - 1] = False
    c[inside] = np.frombuffer(b"".join(words), np.uint8)
    starts = ends - sizes
    b, a = np.r_[_EDGE, c[:-1]][: len(c)], np.r_[_EDGE, _EDGE, c[:-2]][: len(c)]
    a[starts] = _EDGE
    return (a * _SYMBOLS + b) * _SYMBOLS + c, starts


@dataclass(frozen=True)
class Language:
    """``log g`` of the start, the log of the mass of unseen words, and how that is spread."""

    log_start: float
    log_unseen: float
    spelling: Spelling


class Common:
    """Ranks of the commonest words by their hashes, which are in order."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        held = np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=1 << 20)
        self.first = np.r_[0, np.cumsum(held)].astype(np.int32)
        self.most = int(held.max())

    def __reduce__(self) -> tuple:
        return Common, (self.hashes,)

    def of(self, w: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for others."""
        ranks = np.full(len(w), -1, np.int32)
        prefix = (w >> np.uint64(44)).astype(np.int64)
        at, end = self.first[prefix], self.first[prefix + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            here = at[left]
            found = self.hashes[here] == w[left]
            ranks[left[found]] = here[found]
            at[left] += 1
            left = left[~found]
            left = left[at[left] < end[left]]
        return ranks


@dataclass(frozen=True)
class WordLevel:
    """The broadcast half: languages by hash, the commonest words' rows by rank, the commonest bigrams, the bit tables.

    ``of`` is the row of a word's language in ``discounts``. ``seen`` has a bit table for bigrams of commonest words and
    one for other words and bigrams.
    """

    languages: dict[int, Language]
    buckets: int
    common: Common
    p: np.ndarray
    g: np.ndarray
    total: np.ndarray
    of: np.ndarray
    discounts: np.ndarray
    seen: tuple[np.ndarray, np.ndarray]
    pairs: np.ndarray
    gains: np.ndarray


def _pair_gains(model: WordLevel, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    v, w = _pair_ranks(keys)
    d = model.discounts[model.of[v], np.minimum(n, 3)]
    return np.log1p((n - d) / model.total[v] / (model.g[v] * model.p[w]))


def _bit_table(rows: DataFrame, slot, bits: int) -> np.ndarray:
    """A bit for each slot that occurs. At most ``bits / 32768`` rows of 4 KB reach the driver."""
    # The bitmap functions count from one.
    marked = rows.select((slot + 1).alias("slot"))
    parts = marked.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(bits // 8 + 4096, np.uint8)
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * 4096
        table[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def _in_table(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def trusted_texts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, lang, fold, packed)`` of the labelled-good documents, in the shared folder. Fold 0 is held out.

    Only texts whose id's bit is set are shuffled, compressed, to meet the labels.
    """
    spark = docs.sparkSession
    good = labels.filter("quality = 1").select("doc_id").distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(DOCUMENT_BITS))
    table = spark.sparkContext.broadcast(_bit_table(good, slot, DOCUMENT_BITS))

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in rows:
            slots = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(_in_table(table.value, slots)))
            data = [packer.compress(t or b"") for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(data, pa.binary())], names=["doc_id", "lang", "packed"])

    some = docs.select("doc_id", "lang", F.col("text").cast("binary"), slot.alias("slot")).mapInArrow(pack, "doc_id long, lang string, packed binary")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)).cast("int").alias("fold")
    return scratch.write(some.join(good, "doc_id", "left_semi").select("doc_id", "lang", fold, "packed"), "trusted-texts")


def _cross_fitted(trusted: DataFrame) -> DataFrame:
    """The trusted documents, with ``small``: whether their language has few held-out ones."""
    counts = trusted.groupBy(F.col("lang").alias("of_lang")).agg(F.count(F.when(F.col("fold") == 0, 1)).alias("n"))
    few = counts.select("of_lang", (F.col("n") < ENOUGH_HELD_OUT).alias("small"))
    return trusted.join(F.broadcast(few), F.col("lang").eqNullSafe(F.col("of_lang"))).drop("of_lang")


def _training(trusted: DataFrame) -> DataFrame:
    """``(lang, fold, packed)``: each text once for each fold that is trained on it."""
    folds = F.when(F.col("small"), F.sequence(F.lit(0), F.lit(HELD_OUT - 1))).otherwise(F.array(F.lit(0)))
    return trusted.select("lang", F.explode(F.filter(folds, lambda k: k != F.col("fold"))).alias("fold"), "packed")


def _unpacked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in rows:
        texts = [unpack.decompress(data) for data in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], names=["doc_id", "lang", "fold", "text"])


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """``(language hash, text)``."""
    unpack = zstandard.ZstdDecompressor()
    for batch in rows:
        for lang, fold, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield _language_hash(lang, fold), unpack.decompress(data)


def _count_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, place, word, n)`` of the distinct words of each few million, and of the starts, which have no word."""
    keys, places, words = [], [], []

    def distinct() -> pa.RecordBatch:
        own, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        place = np.repeat(np.array(places, np.uint64), list(map(len, keys)))[first]
        starts, texts = np.unique(np.array(places, np.uint64), return_counts=True)
        spelt = pa.array([*(words[i] for i in first.tolist()), *[None] * len(starts)], pa.binary())
        columns = [np.r_[own, starts].view(np.int64), np.r_[place, starts].view(np.int64), spelt, np.r_[n, texts]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "place", "word", "n"])

    for place, text in _texts(rows):
        own = _hashes(place, text)
        if not len(own):
            continue
        keys.append(own)
        places.append(place)
        words += text.lower().split()
        if len(words) > TRAINING_WORDS:
            yield distinct()
            keys, places, words = [], [], []
    if words:
        yield distinct()


def _gathered(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches."""
    held, waiting = [], 0
    for batch in rows:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= size:
            yield pa.concat_batches(held)
            held, waiting = [], 0
    if held:
        yield pa.concat_batches(held)


def _count_trigrams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(rows, 100_000):
        places, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for place in np.unique(places):
            keys, counts = np.unique(_trigrams([words[i] for i in np.flatnonzero(places == place).tolist()])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), place)), pa.array(keys), pa.array(counts)], names=["place", "key", "n"])


_DATA = "bucket int, data binary"


def _data(buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _dealt(keys: np.ndarray, first: int, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns in the order of the keys, cut into buckets that are counted from ``first``; the keys themselves as steps."""
    cuts = _cuts(keys, buckets)
    spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    some = [i for i, s in enumerate(spans) if s.start < s.stop]
    return _data([first + i for i in some], [_pressed(*(_steps(c[spans[i]]) if c is keys else c[spans[i]] for c in columns)) for i in some])


def _count_bigrams(rows: Iterator[pa.RecordBatch], common: Common, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each few million bigrams: ``(key, n)`` of those of commonest words in the first buckets, ``(v, w, n)`` of others in as many further ones."""
    held, waiting = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        v, w = (np.concatenate([h[i] for h in held]) for i in range(2))
        own, before = common.of(w), common.of(v)
        often = (own >= 0) & (before >= 0)
        keys, n = np.unique(_pair_keys(before[often], own[often]), return_counts=True)
        yield _dealt(keys, 0, buckets, keys, n)
        v, w = v[~often], w[~often]
        keys, first, n = np.unique(_bigram_keys(v, w), return_index=True, return_counts=True)
        yield _dealt(keys, buckets, buckets, v[first], w[first], n)

    for place, text in _texts(rows):
        w = _hashes(place, text)
        if not len(w):
            continue
        held.append((_followers(place, w)[1], w))
        waiting += len(w)
        if waiting > TRAINING_WORDS:
            yield from counted()
            held, waiting = [], 0
    if held:
        yield from counted()


def _joined(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and what belongs to them."""
    columns = [_unpressed(data, "<u8", "<i8") for data in parts]
    return np.concatenate([np.cumsum(steps) for steps, _ in columns]), np.concatenate([value for _, value in columns])


def _by_bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The data of each bucket, of rows in their order."""
    pairs = (row for batch in rows for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for bucket, own in groupby(pairs, lambda row: row[0]):
        yield bucket, (data for _, data in own)


_BIGRAMS = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("v", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])


def _merge_bigrams(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of ``data`` for each of the first buckets, a row ``(v, w, n)`` for each bigram of the others."""
    for bucket, parts in _by_bucket(rows):
        if bucket < buckets:
            keys, n = _joined(parts)
            keys, _, (n,) = _added_up(keys, n)
            yield pa.RecordBatch.from_arrays([*_data([bucket], [_pressed(_steps(keys), n)]).columns, *(pa.nulls(1, pa.int64()) for _ in range(3))], schema=_BIGRAMS)
            continue
        v, w, n = map(np.concatenate, zip(*(_unpressed(data, "<u8", "<u8", "<i8") for data in parts)))
        _, first, (n,) = _added_up(_bigram_keys(v, w), n)
        for i in range(0, len(n), 100_000):
            some = first[i : i + 100_000]
            columns = [pa.array(x) for x in (np.full(len(some), bucket, np.int32), v[some].view(np.int64), w[some].view(np.int64), n[i : i + 100_000])]
            yield pa.RecordBatch.from_arrays([columns[0], pa.nulls(len(some), pa.binary()), *columns[1:]], schema=_BIGRAMS)


_COUNTS = ["before", "total", "k1", "k2", "k3", "k4", "after"]


def _count_pairs(rows: Iterator[pa.RecordBatch], common: Common) -> Iterator[pa.RecordBatch]:
    """What bigrams of commonest words count for each of them: its distinct predecessors, how often it is followed, its followers by count."""
    size, sums = len(common.hashes), np.zeros((len(_COUNTS), len(common.hashes)), np.int64)
    for batch in rows:
        for data in batch.column(1).to_pylist():
            steps, n = _unpressed(data, "<u8", "<i8")
            v, w = _pair_ranks(np.cumsum(steps))
            parts = [np.bincount(w, minlength=size), np.bincount(v, n, size), *(np.bincount(v[n == k], minlength=size) for k in (1, 2, 3, 4)), np.bincount(v, minlength=size)]
            sums += np.array(parts).astype(np.int64)
    some = np.flatnonzero(sums.any(0))
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(common.hashes[part].view(np.int64)), *(pa.array(x[part]) for x in sums)], names=["key", *_COUNTS])


def _count_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(n, kinds)``: how many bigrams of commonest words there are of each count."""
    for batch in rows:
        for data in batch.column(1).to_pylist():
            n, kinds = np.unique(_unpressed(data, "<u8", "<i8")[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(kinds)], names=["n", "kinds"])


def _mark(rows: Iterator[pa.RecordBatch], buckets: int, bits: list[int]) -> Iterator[pa.RecordBatch]:
    """The part of a bit table that a bucket's keys have: it is a range, as the slot is a key's highest bits."""
    for batch in rows:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = bits[bucket // buckets]
            table = np.zeros(own // buckets, bool)
            table[_slots(np.cumsum(_unpressed(data, "<u8", "<i8")[0]), own) - bucket % buckets * len(table)] = True
            yield _data([bucket], [np.packbits(table, bitorder="little").tobytes()])


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _deal_words(rows: Iterator[pa.RecordBatch], common: Common, languages: dict[int, Language], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a seen word that is not one of the commonest adds to what its spelling gives, within a text and at its end."""
    for batch in _gathered(rows, _DEALT // 4):
        keys, place, p, g = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
        rare = np.flatnonzero(common.of(keys.view(np.uint64)) < 0)
        words = batch.column(2).take(pa.array(rare)).to_pylist()
        keys, place, a, b = keys.view(np.uint64)[rare], place[rare], np.log(p[rare]), np.log(g[rare])
        for one in np.unique(place).tolist():
            own = np.flatnonzero(place == one)
            a[own] -= languages[one].log_unseen + languages[one].spelling.log_prob([words[i] for i in own.tolist()])
        yield _deal_gains(np.r_[keys, _last_keys(keys)], np.r_[a + b, a], buckets)


def _deal_bigrams(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(rows, _DEALT):
        v, w = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
        yield _deal_gains(_bigram_keys(v, w), batch.column(2).to_numpy(), buckets)


def _deal_gains(keys: np.ndarray, gains: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys = keys[order]
    return _dealt(keys, buckets, buckets, keys, np.rint(gains[order] * _UNIT).astype(np.int64))


def _merge_gains(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, parts in _by_bucket(rows):
        keys, gains = _joined(parts)
        order = np.argsort(keys)
        yield _data([bucket], [_pressed(_steps(keys[order]), gains[order])])


def _discounts(counts_of_counts: list[float]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the numbers of entries with counts 1 to 4, by count (0, 1, 2, 3+)."""
    n1, n2, n3, n4 = (max(float(n), 1.0) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), c - 0.05) for c, d in enumerate(raw, 1))])


def _parts(spark: SparkSession) -> int:
    return min(MOST_PARTS, max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def train(texts: DataFrame, scratch: Scratch) -> tuple[WordLevel, tuple[DataFrame, DataFrame]]:
    """The broadcast half of the model, and the tables of the rest of ``texts`` (lang, fold, packed) by bucket.

    The first has counts of bigrams of commonest words, ``(bucket, data)`` and rows without data; the other has gains of
    other words and bigrams.
    """
    spark = texts.sparkSession
    parts = _parts(spark)
    counted = texts.mapInArrow(_count_words, "key long, place long, word binary, n long").groupBy("key")
    words = scratch.write(counted.agg(F.first("place").alias("place"), F.first("word").alias("word"), F.sum("n").alias("n")), "vocabulary")
    del counted
    scratch.free_shuffles()
    spelling = words.filter("word IS NOT NULL").select("place", "word").mapInArrow(_count_trigrams, "place long, key long, n long")
    trigrams = spelling.groupBy("place", "key").agg(F.sum("n").alias("n")).toArrow()
    spelt = [trigrams[c].to_numpy() for c in ("place", "key", "n")]
    often = words.orderBy(F.desc("n"), "key").limit(COMMONEST).select("key").toArrow()["key"].to_numpy()
    common = Common(np.sort(often.view(np.uint64)))
    buckets = max(LEAST_BUCKETS, power_of_two((words.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    shared = spark.sparkContext.broadcast(common)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_bigrams(rows, shared.value, buckets)

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge_bigrams(rows, buckets)

    dealt = texts.mapInArrow(count, _DATA).repartition(parts, "bucket").sortWithinPartitions("bucket")
    bigrams = scratch.write(dealt.mapInArrow(merge, "bucket int, data binary, v long, w long, n long"), "bigrams")
    del dealt, spelling
    scratch.free_shuffles()
    pairs, rare = bigrams.filter("data IS NOT NULL").select("bucket", "data"), bigrams.filter("data IS NULL").select("v", "w", "n")

    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_pairs(rows, shared.value)

    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    as_context = [none, F.col("n"), *(F.when(F.col("n") == k, one).otherwise(none) for k in (1, 2, 3, 4)), one]
    as_word = [one, *[none] * 6]
    stats = pairs.mapInArrow(sums, f"key long, {', '.join(f'{c} long' for c in _COUNTS)}")
    for key, counts in (("v", as_context), ("w", as_word)):
        stats = stats.union(rare.select(F.col(key).alias("key"), *(c.alias(name) for c, name in zip(counts, _COUNTS))))
    levels = scratch.write(words.join(stats.groupBy("key").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "key"), "word-counts")
    del stats
    scratch.spent(words)
    scratch.free_shuffles()

    histogram = [F.count(F.when(F.col("before") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    tops = [F.sum(f"k{k}").alias(f"k{k}") for k in (1, 2, 3, 4)]
    by_place = levels.groupBy("place").agg(*histogram, *tops, F.count(F.when(F.col("before") > 0, 1)).alias("kinds"), F.sum("before").alias("mass"), F.sum("after").alias("after"))
    fixed, unseen, discounts, held, kinds = [], {}, [], 0, 0
    for r in by_place.collect():
        top, low = _discounts([r[f"k{k}"] for k in (1, 2, 3, 4)]), _discounts([r[f"n{k}"] for k in (1, 2, 3, 4)])
        left = float(low[[1, 2, 3]] @ [r["n1"], r["n2"], r["kinds"] - r["n1"] - r["n2"]]) / r["mass"]
        unseen[r["place"]] = left * (1 - r["kinds"] / _WIDTH)
        fixed.append((r["place"], len(fixed), *map(float, top[1:]), *map(float, low[1:]), float(r["mass"]), left / _WIDTH))
        discounts.append(top)
        held, kinds = held + r["after"], kinds + r["kinds"]
    fixed = F.broadcast(spark.createDataFrame(fixed, "place long, of int, d1 double, d2 double, d3 double, l1 double, l2 double, l3 double, mass double, least double"))

    def by_count(column: str, name: str) -> Column:
        return F.when(F.col(column) == 1, F.col(f"{name}1")).when(F.col(column) == 2, F.col(f"{name}2")).otherwise(F.col(f"{name}3"))

    p = F.when(F.col("before") > 0, (F.col("before") - by_count("before", "l")) / F.col("mass") + F.col("least"))
    left = F.col("k1") * F.col("d1") + F.col("k2") * F.col("d2") + (F.col("after") - F.col("k1") - F.col("k2")) * F.col("d3")
    g = F.when(F.col("total") > 0, left / F.col("total")).otherwise(1.0)
    valued = levels.join(fixed, "place").select("key", "place", "of", "word", "n", "total", p.alias("p"), g.alias("g"))
    languages = {}
    for r in valued.filter("p IS NULL").select("place", F.log("g")).collect():
        own = spelt[0] == r[0]
        languages[r[0]] = Language(r[1], float(np.log(unseen[r[0]])), Spelling(spelt[1][own], spelt[2][own]))
    rows = valued.orderBy(F.desc("n"), "key").limit(COMMONEST).select("key", "of", "total", F.coalesce("p", F.lit(1.0)).alias("p"), "g").toArrow()
    order = np.argsort(rows["key"].to_numpy().view(np.uint64))
    of, total, p, g = (rows[c].to_numpy()[order] for c in ("of", "total", "p", "g"))

    spellings = spark.sparkContext.broadcast(languages)

    def deal_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _deal_words(rows, shared.value, spellings.value, buckets)

    def deal_bigrams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _deal_bigrams(rows, buckets)

    known = rare.join(valued.select(F.col("key").alias("v"), F.col("total").alias("c"), F.col("g").alias("gv")), "v")
    known = known.join(valued.select(F.col("key").alias("w"), "place", F.col("p").alias("pw")), "w").join(fixed, "place")
    gain = F.log1p((F.col("n") - by_count("n", "d")) / F.col("c") / (F.col("gv") * F.col("pw")))
    gains = known.select("v", "w", gain.alias("a")).mapInArrow(deal_bigrams, _DATA)
    gains = gains.union(valued.filter("p IS NOT NULL").select("key", "place", "word", "p", "g").mapInArrow(deal_words, _DATA))
    others = scratch.write(gains.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_gains, _DATA), "gains")
    del known, gains, valued
    scratch.spent(levels)
    scratch.free_shuffles()

    further = rare.count()
    counts = [held - further, further + 2 * max(0, kinds - COMMONEST)]
    bits = [max(1 << 16, 8 * buckets, min(MOST_SEEN_BITS, power_of_two(SEEN_BITS * n))) for n in counts]

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _mark(rows, buckets, bits)

    seen = [np.zeros(n // 8, np.uint8) for n in bits]
    for r in pairs.union(others).mapInArrow(mark, _DATA).toLocalIterator():
        part = np.frombuffer(r["data"], np.uint8)
        start = r["bucket"] % buckets * len(part)
        seen[r["bucket"] // buckets][start : start + len(part)] = part
    scratch.free_shuffles()
    model = WordLevel(languages, buckets, common, p, g, total, of, np.array(discounts).reshape(-1, 4), tuple(seen), *[np.zeros(0)] * 2)

    by_number = pairs.mapInArrow(_count_counts, "n long, kinds long").groupBy("n").agg(F.sum("kinds").alias("kinds")).collect()
    least, room = 1 << 62, COMMONEST_PAIRS
    for n, k in sorted(by_number, reverse=True):
        if (room := room - k) < 0:
            break
        least = n

    def commonest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                steps, n = _unpressed(data, "<u8", "<i8")
                yield _data([bucket], [_pressed(np.cumsum(steps)[n >= least], n[n >= least])])

    top = [_unpressed(r["data"], "<u8", "<i8") for r in pairs.mapInArrow(commonest, _DATA).toLocalIterator()]
    keys, n = map(np.concatenate, zip(*top)) if top else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(keys)
    return replace(model, pairs=keys[order], gains=_pair_gains(model, keys, n)[order]), (bigrams, others)


_MODEL, _DOCUMENTS, _ASKED = range(3)
_DOC = "doc_id long, lang string, fold int, n_words long, log_prob double"
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("fold", pa.int32()), ("n_words", pa.int64()), ("log_prob", pa.float64())])
_SENT = "bucket int, kind int, chunk long, data binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def _ask(model: WordLevel, side: int, keys: np.ndarray, owner: np.ndarray, gained: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with the distinct keys that may have been seen and their documents. Gains of bigrams that are copied go to ``gained``."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    counts = np.diff(starts, append=len(keys))
    keys = keys[starts]
    send = _in_table(model.seen[side], _slots(keys, 8 * len(model.seen[side])))
    if side == 0 and len(model.pairs):
        at = np.minimum(np.searchsorted(model.pairs, keys), len(model.pairs) - 1)
        copied = model.pairs[at] == keys
        here = np.repeat(copied, counts)
        gained += np.bincount(owner[here], np.repeat(model.gains[at[copied]], counts[copied]), len(gained))
        send &= ~copied
    owner, keys, counts = owner[np.repeat(send, counts)].astype("<u2"), keys[send], counts[send].astype("<u4")
    cuts, ends = _cuts(keys, model.buckets), np.r_[0, np.cumsum(counts, dtype=np.int64)]
    some = np.flatnonzero(np.diff(cuts)).tolist()
    spans = [slice(cuts[i], cuts[i + 1]) for i in some]
    data = [_pressed(_steps(keys[s]), counts[s], owner[ends[s.start] : ends[s.stop]]) for s in spans]
    yield _sent_rows([side * model.buckets + i for i in some], _ASKED, chunk, data)


def _sent_rows(buckets: list[int], kind: int, chunk: int, data: list[bytes]) -> pa.RecordBatch:
    count = len(buckets)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(np.full(count, kind, np.int32)), pa.array(np.full(count, chunk)), pa.array(data, pa.binary())], schema=_SENT_ARROW
    )


def _chunk_rows(model: WordLevel, docs: list[tuple], hashes: list[np.ndarray], spelt: list[bytes], chunk: int) -> Iterator[pa.RecordBatch]:
    """Of a chunk of documents: what a worker knows, in one row, and what it asks of each bucket."""
    sizes, total = np.array(list(map(len, hashes))), np.array([d[4] for d in docs])
    place = np.array([d[5] for d in docs], np.uint64)
    owner, ends = np.repeat(np.arange(len(docs)), sizes), np.cumsum(sizes)
    some = sizes > 0
    w = np.concatenate(hashes)
    rank = model.common.of(w)
    v, before = np.r_[w[:1], w[:-1]], np.r_[rank[:1], rank[:-1]]
    v[(ends - sizes)[some]], before[(ends - sizes)[some]] = place[some], model.common.of(place[some])
    within = np.ones(len(w), bool)
    within[ends[some] - 1] = False
    known = rank >= 0
    total += np.bincount(owner[known], np.log(model.p[rank[known]]), len(docs))
    total += np.bincount(owner[known & within], np.log(model.g[rank[known & within]]), len(docs))
    rare = np.flatnonzero(~known)
    distinct, first, at = np.unique(w[rare], return_index=True, return_inverse=True)
    base, of = np.zeros(len(distinct)), place[owner[rare[first]]]
    for one in np.unique(of).tolist():
        own, language = np.flatnonzero(of == one), model.languages[_signed(one)]
        base[own] = language.log_unseen + language.spelling.log_prob([spelt[i] for i in first[own].tolist()])
    total += np.bincount(owner[rare], base[at], len(docs))
    often = known & (before >= 0)
    yield from _ask(model, 0, _pair_keys(before[often], rank[often]), owner[often], total, chunk)
    other = np.flatnonzero(~often)
    words = np.where(within[rare], w[rare], _last_keys(w[rare]))
    yield from _ask(model, 1, np.r_[_bigram_keys(v[other], w[other]), words], np.r_[owner[other], owner[rare]], total, chunk)
    columns = [*([d[i] for d in docs] for i in range(4)), total]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DOC_ARROW)], schema=_DOC_ARROW)
    yield _sent_rows([chunk % (2 * model.buckets)], _DOCUMENTS, chunk, [zstandard.compress(batch.serialize().to_pybytes(), 1)])


def _sent(rows: Iterator[pa.RecordBatch], model: WordLevel) -> Iterator[pa.RecordBatch]:
    """The rows of all chunks of documents."""
    chunk = TaskContext.get().partitionId() << 32
    docs, hashes, spelt, waiting = [], [], [], 0
    for batch in rows:
        for name, lang, fold, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            place = _language_hash(lang, fold)
            language = model.languages.get(_signed(place))
            if language is None and fold:
                continue
            w = _hashes(place, text)
            waiting += len(w)
            if language is None:
                # Without trusted text every word is as likely as any other.
                docs.append((name, lang, -1, len(w), -len(w) * float(np.log(_WIDTH)), place))
                hashes.append(w[:0])
            else:
                docs.append((name, lang, fold, len(w), language.log_start * (len(w) > 0), place))
                hashes.append(w)
                if len(rare := np.flatnonzero(model.common.of(w) < 0)):
                    all_words = text.lower().split()
                    spelt += [all_words[i] for i in rare.tolist()]
            if waiting > CHUNK_WORDS or len(docs) == 65_536:
                yield from _chunk_rows(model, docs, hashes, spelt, chunk)
                docs, hashes, spelt, waiting, chunk = [], [], [], 0, chunk + 1
    if docs:
        yield from _chunk_rows(model, docs, hashes, spelt, chunk)


_PART = "chunk long, kind int, data binary"
_PART_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _met(rows: Iterator[pa.RecordBatch], model: WordLevel) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are, and what the keys of a chunk add, summed by document as far as they are here."""
    held: dict[int, np.ndarray] = {}
    size, ready_for, keys, gains = 0, -1, None, None

    def handed() -> Iterator[pa.RecordBatch]:
        for chunk, sums in held.items():
            place = np.flatnonzero(sums)
            yield _part(chunk, _ASKED, _pressed(np.diff(place, prepend=0).astype("<u2"), sums[place]))
        held.clear()

    for batch in rows:
        for bucket, kind, chunk, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if kind == _MODEL:
                ready_for, (steps, value) = bucket, _unpressed(data, "<u8", "<i8")
                keys = np.cumsum(steps)
                gains = _pair_gains(model, keys, value) if bucket < model.buckets else value / _UNIT
            elif kind == _DOCUMENTS:
                yield _part(chunk, kind, data)
            elif ready_for == bucket:
                steps, counts, owner = _unpressed(data, "<u8", "<u4", "<u2")
                asked = np.cumsum(steps)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                gained = np.where(keys[at] == asked, gains[at], 0.0)
                sums = np.bincount(owner, np.repeat(gained, counts))
                if chunk not in held:
                    if size > _HELD:
                        yield from handed()
                        size = 0
                    held[chunk] = np.zeros(0)
                if len(sums) > len(own := held[chunk]):
                    size += len(sums) - len(own)
                    own, sums = sums, own
                own[: len(sums)] += sums
                held[chunk] = own
    yield from handed()


def _part(chunk: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], schema=_PART_ARROW)


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk with all that was added. Rows come by chunk, the documents first."""
    docs, total = None, np.zeros(0)

    def done() -> Iterator[pa.RecordBatch]:
        if docs is not None:
            yield pa.RecordBatch.from_arrays([*docs.columns[:4], pa.array(total)], schema=_DOC_ARROW)

    for batch in rows:
        for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if kind == _DOCUMENTS:
                yield from done()
                docs = pa.ipc.read_record_batch(pa.py_buffer(zstandard.decompress(data)), _DOC_ARROW)
                total = docs.column(4).to_numpy().copy()
            else:
                steps, sums = _unpressed(data, "<u2", "<f8")
                total[np.cumsum(steps, dtype=np.int64)] += sums
    yield from done()


def score(docs: DataFrame, model: WordLevel, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``(doc_id, lang, fold, n_words, log_prob)``, one row per row of ``docs`` (doc_id, lang, fold, text).

    ``fold`` is -1 if the language has no trusted text; rows of a further fold without any are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(rows, shared.value)

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(rows, shared.value)

    bigrams, others = tables
    known = bigrams.filter("data IS NOT NULL").select("bucket", "data").union(others)
    known = known.select("bucket", F.lit(_MODEL).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "data")
    dealt = docs.mapInArrow(send, _SENT).union(known).repartition(_parts(spark), "bucket").sortWithinPartitions("bucket", "kind", "chunk")
    return dealt.mapInArrow(meet, _PART).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_summed, _DOC)


def judge_perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, n_words, perplexity, threshold, kept)``, one row per row of ``docs`` (doc_id, lang, text).

    ``labels`` has doc_id and quality (1: trusted). A text without words has no perplexity and is not kept. Every
    language has a threshold whose trusted documents lie in two folds at least: the quantile of its own, drawn to the
    pooled one the more the fewer they are. Others have none and keep their texts; without trusted text every word is as
    likely as any other. Repeated rows give repeated rows; an empty table gives none; further columns are left out.
    """
    scratch = Scratch(ready(docs.sparkSession))
    packed = trusted_texts(docs, labels, scratch)
    scratch.free_shuffles()
    trusted = _cross_fitted(packed)
    model, tables = train(_training(trusted), scratch)
    # Only texts of small languages are scored by other folds' models: the others' are spent.
    again = trusted.filter(F.col("small") & (F.col("fold") > 0)).select("doc_id", "lang", "fold", "packed")
    again = scratch.write(again, "cross-fitted-texts")
    scratch.spent(packed)
    scratch.free_shuffles()
    again = again.mapInArrow(_unpacked, "doc_id long, lang string, fold int, text binary")
    every = docs.select("doc_id", "lang", F.lit(0).alias("fold"), F.col("text").cast("binary").alias("text")).union(again)
    scored = score(every, model, tables).withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))))
    scored = scratch.write(scored, "perplexities")
    scratch.spent(*tables)
    scratch.free_shuffles()

    held_out = labels.filter("quality = 1").select("doc_id").distinct().filter(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    known = scored.filter("n_words > 0")
    known = known.filter("fold = 0").join(held_out, "doc_id", "left_semi").union(known.filter("fold > 0").select("doc_id", *[c for c in scored.columns if c != "doc_id"]))
    known = known.select(F.col("lang").alias("of_lang"), (-F.col("log_prob") / F.col("n_words")).alias("x"))
    high = [F.lit(quantile), F.lit(10_000)]
    own = known.groupBy("of_lang").agg(F.percentile_approx("x", F.lit(0.5), F.lit(10_000)).alias("mid"), F.percentile_approx("x", *high).alias("top"), F.count("*").alias("n"))
    away = known.join(F.broadcast(own.withColumnRenamed("of_lang", "lang")), F.col("of_lang").eqNullSafe(F.col("lang")))
    pooled = away.agg(F.percentile_approx(F.col("x") - F.col("mid"), *high).alias("spread"))
    drawn = (F.col("n") * F.col("top") + POOLED_WEIGHT * (F.col("mid") + F.col("spread"))) / (F.col("n") + POOLED_WEIGHT)
    limits = own.crossJoin(F.broadcast(pooled)).select("of_lang", F.exp(drawn).alias("threshold"))
    judged = scored.filter("fold <= 0").join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    kept = (F.col("n_words") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return judged.select("doc_id", "lang", "n_words", "perplexity", "threshold", kept.alias("kept"))
