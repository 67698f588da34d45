"""Token ids of documents as one concatenated array, cut into blocks, with Elias-Fano coded document ends.

File format (a folder of Parquet files, so that Spark commits them as a whole and any store will do). One row is one
block of whole documents in ascending doc_id order:

======================  ==============================================================================================
``shard``, ``block``    place of the block: blocks of a shard in order, shards in order
``ids_before``          ids in the earlier blocks of the shard
``doc_ids``             the documents of the block
``ids``                 their ids, little-endian unsigned 32-bit, one after the other
``n_ids``               number of ids
``ends_low_bits`` ...   :class:`~emberlog.llm.elias_fano.EliasFano` code of the document ends within the block
======================  ==============================================================================================

A block closes at :data:`BLOCK_IDS` ids, so ends take few bits; a longer document has a block of its own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import batches, ready
from emberlog.llm.elias_fano import EliasFano

BLOCK_IDS = 1 << 16
END_ID = 2

#: Words whose ids a worker remembers; it starts afresh when they are more.
REMEMBERED = 800_000

_BLOCK = (
    "shard int, block int, ids_before long, doc_ids array<long>, n_ids long, ids binary, "
    "ends_low_bits int, ends_low binary, ends_high binary, ends_samples binary"
)
_BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("ids_before", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
        ("ids", pa.binary()),
        ("ends_low_bits", pa.int32()),
        ("ends_low", pa.binary()),
        ("ends_high", pa.binary()),
        ("ends_samples", pa.binary()),
    ]
)


#: ASCII symbols that never join a letter or digit before them: they make a token run of their own.
_TAIL = ".,!?*$&%#;:"


class _Encoder:
    """Encodes texts word by word and remembers the words' ids as bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its blank-separated parts;
    and a part that ends in symbols after a letter or digit has the ids of its head and of its tail.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(set(chain.from_iterable(parts)).difference(self.known))
        known, end = self.known, END_ID.to_bytes(4, "little")
        known[""] = b""
        # All words of a text in one lookup; the empty one makes them two at least, hence a tuple.
        return [np.frombuffer(b"".join(itemgetter("", *part)(known)) + end, dtype="<u4") for part in parts]

    def _learn(self, new: set[str]) -> None:
        known, cut = self.known, []
        plain: set[str] = set()
        other: set[str] = set()
        for word in new:
            if word.isalpha() and word.isascii() and word.islower():  # the commonest kind needs no cutting
                plain.add(word)
                continue
            head = word.rstrip(_TAIL)
            if head and head[-1].isalnum() and is_normalized("NFC", head[-1]):
                small = head.lower() if head.isascii() and head.isalpha() else head
                tail = word[len(head) :]
                if small != word:
                    cut.append((word, small, tail))
                    if tail and tail not in known:
                        other.add(tail)
            else:
                small = word
            if small not in known:
                (plain if small.isalpha() else other).add(small)
        self._encode_letters(list(plain))
        self._encode_one_by_one(list(other))
        for word, small, tail in cut:
            known[word] = known[small] + known[tail] if tail else known[small]

    def _encode_one_by_one(self, parts: list[str]) -> None:
        for part, code in zip(parts, self.tokenizer.encode_batch(parts, add_special_tokens=False)):
            self.known[part] = np.array(code.ids, dtype="<u4").tobytes()

    def _encode_letters(self, parts: list[str], together: int = 500) -> None:
        """Runs of letters are one word each to the tokenizer, so many are encoded as one text."""
        for start in range(0, len(parts), together):
            some = parts[start : start + together]
            code = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            places = np.array(code.word_ids, dtype=np.int64)
            if not len(places) or places[-1] + 1 != len(some):  # normalization split a run
                self._encode_one_by_one(some)
                continue
            ids = np.array(code.ids, dtype="<u4")
            cuts = np.searchsorted(places, np.arange(len(some) + 1)).tolist()
            data = ids.tobytes()
            for i, part in enumerate(some):
                self.known[part] = data[4 * cuts[i] : 4 * cuts[i + 1]]


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(tokenizer_path: str) -> _Encoder:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = _Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _blocks(texts: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[tuple]:
    encoder, shard = _encoder(tokenizer_path), TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    names: list[int | None] = []
    block = before = waiting = 0

    def close() -> tuple:
        ends = EliasFano.encode(np.cumsum([len(x) for x in held]))
        ids = np.concatenate(held)
        return shard, block, before, list(names), len(ids), ids.tobytes(), ends.low_bits, ends.low, ends.high, ends.samples

    for batch in texts:
        for name, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist())):
            if held and waiting + len(ids) > BLOCK_IDS:
                yield close()
                block, before, waiting, held, names = block + 1, before + waiting, 0, [], []
            held.append(ids)
            names.append(name)
            waiting += len(ids)
    if held:
        yield close()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the files.

    Null and empty texts give the end id alone. Rows with the same doc_id stay side by side in the order of their text;
    a null doc_id comes first. An empty table gives files without blocks.
    """
    spark = ready(docs.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(_blocks(texts, tokenizer_path), _BLOCK_ARROW, 8)

    ordered.mapInArrow(encode, _BLOCK).write.parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """``(shard, shard_start)``: ids before each shard. One row per shard, which is one per task of the writer."""
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def document_ids(row: dict, index: int) -> np.ndarray:
    """The ids of one document of a block, found by two selects."""
    ends = EliasFano(len(row["doc_ids"]), row["ends_low_bits"], row["ends_low"], row["ends_high"], row["ends_samples"])
    start = ends.select(index - 1) if index else 0
    return np.frombuffer(row["ids"], "<u4", ends.select(index) - start, 4 * start)


_READ = "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long"
_READ_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("shard", pa.int32()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def _documents(blocks: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in blocks:
        for row in batch.to_pylist():
            code = EliasFano(len(row["doc_ids"]), row["ends_low_bits"], row["ends_low"], row["ends_high"], row["ends_samples"])
            ids, start = memoryview(row["ids"]), 0
            for name, end in zip(row["doc_ids"], code.decode().tolist()):
                yield name, row["shard"], row["ids_before"] + start, end - start, zlib.crc32(ids[4 * start : 4 * end])
                start = end


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""
    blocks = ready(spark).read.parquet(path)

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(_documents(rows), _READ_ARROW, 10_000)

    found = blocks.select(
        "shard", "ids_before", "doc_ids", "ids", "ends_low_bits", "ends_low", "ends_high", "ends_samples"
    ).mapInArrow(decode, _READ)
    return found.join(block_starts(blocks), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )
