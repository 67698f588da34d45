"""Quality rules: simple counts, and the divergence of a document's histograms from those of its language.

Two histograms describe a document: character classes, and the commonest words of its language (all others as one). The
references are the same histograms summed over all documents of the language. The Jensen-Shannon distance (square root
of the divergence to base 2, from 0 to 1) between document and reference rejects what does not look like the language:
symbol soup, tables of numbers, shouting, a wrong language. Short documents have noisy histograms, so each distance is
used from a length of its own only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import batches, ready, words

# Fixed values of the rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Common words of a language, and the least words of a language that make a reference.
COMMON_WORDS = 64
LEAST_REFERENCE_WORDS = 5_000

#: Words from which a distance is used, and distances from which a document is rejected.
CHARACTER_GUARD, CHARACTER_LIMIT = 50, 0.30
WORD_GUARD, WORD_LIMIT = 80, 0.47

#: Distinct words a worker counts before it hands the counts on.
_HELD_WORDS = 200_000

_CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other letter", "control")


def _byte_classes() -> np.ndarray:
    classes = np.full(256, len(_CLASSES), dtype=np.uint8)  # UTF-8's following bytes: not counted
    for byte in range(256):
        if 97 <= byte <= 122:
            classes[byte] = 0
        elif 65 <= byte <= 90:
            classes[byte] = 1
        elif 48 <= byte <= 57:
            classes[byte] = 2
        elif byte == 32 or 9 <= byte <= 13:
            classes[byte] = 3
        elif chr(byte) in ".,;:!?'\"()-":
            classes[byte] = 4
        elif byte < 32 or byte == 127:
            classes[byte] = 7
        elif byte < 128:
            classes[byte] = 5
        elif byte >= 0xC0:
            classes[byte] = 6
    return classes


_BYTE_CLASSES = _byte_classes()


def character_histogram(text: bytes) -> np.ndarray:
    return np.bincount(_BYTE_CLASSES[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 1)[: len(_CLASSES)]


def distance(one: np.ndarray, other: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not one.sum() or not other.sum():
        return 0.0
    p, q = one / one.sum(), other / other.sum()
    m = (p + q) / 2

    def against(x: np.ndarray) -> float:
        there = x > 0
        return float((x[there] * np.log2(x[there] / m[there])).sum())

    return max(0.0, (against(p) + against(q)) / 2) ** 0.5


@dataclass(frozen=True)
class Reference:
    """Histograms of a language; ``places`` numbers its common words, the last cell is all others."""

    characters: np.ndarray
    places: dict[bytes, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def words(self, counted: Counter, total: int) -> np.ndarray:
        cells = np.zeros(len(self.places) + 1)
        for word, place in self.places.items():
            cells[place] = counted.get(word, 0)
        cells[-1] = total - cells.sum()
        return cells


def _vocabulary_word(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?'\"()")


_COUNTED = "lang string, kind string, key binary, n long"
_COUNTED_ARROW = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64())])


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Word and character-class counts by language; handed on whenever many words are held."""
    held: Counter = Counter()
    for batch in rows:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                counts = Counter(map(_vocabulary_word, words(text)))
                held.update({(lang, "word", word): n for word, n in counts.items()})
                held[lang, "total", b""] += sum(counts.values())
                cells = character_histogram(text).tolist()
                held.update({(lang, "class", b"%d" % i): n for i, n in enumerate(cells) if n})
        if len(held) > _HELD_WORDS:
            yield from ((*key, n) for key, n in held.items())
            held.clear()
    yield from ((*key, n) for key, n in held.items())


def language_references(docs: DataFrame) -> dict[str | None, Reference]:
    """Histograms over all documents of each language (null is one).

    Languages with fewer than :data:`LEAST_REFERENCE_WORDS` words have none. What reaches the driver is
    ``COMMON_WORDS + 9`` rows per language code.
    """
    ready(docs.sparkSession)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(_counted(rows), _COUNTED_ARROW, 20_000)

    sums = (
        docs.select("lang", F.col("text").cast("binary"))
        .mapInArrow(count, _COUNTED)
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    found: dict[str | None, dict[str, list]] = {}
    for row in sums.withColumn("rank", rank).filter(F.col("rank") <= COMMON_WORDS).collect():
        found.setdefault(row["lang"], {"word": [], "class": [], "total": []})[row["kind"]].append((row["rank"], bytes(row["key"]), row["n"]))
    references = {}
    for lang, kinds in found.items():
        total = kinds["total"][0][2]
        if total < LEAST_REFERENCE_WORDS:
            continue
        characters = np.zeros(len(_CLASSES))
        for _, key, n in kinds["class"]:
            characters[int(key)] = n
        common = sorted(kinds["word"])
        counts = np.array([*(n for _, _, n in common), 0.0])
        counts[-1] = total - counts.sum()
        references[lang] = Reference(characters, {key: i for i, (_, key, _) in enumerate(common)}, counts)
    return references


def rule_counts(text: bytes, tokens: list[bytes]) -> tuple[int, int, int, int]:
    """``(word_chars, n_symbols, n_dup_lines, n_repeat_words)``."""
    word_chars = sum(map(len, tokens))
    if not text.isascii():  # code points, not bytes
        word_chars = len(b"".join(tokens).decode("utf-8", "replace"))
    n_symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen: set[bytes] = set()
    n_dup_lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += bool(line.strip())
        seen.add(line)
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    n_repeat_words = 0
    if len(set(windows)) < len(windows):
        often, covered = Counter(windows), 0  # covered: words before this place that are counted already
        for i, window in enumerate(windows):
            if often[window] > 1:
                n_repeat_words += i + 3 - max(i, covered)
                covered = i + 3
    return word_chars, n_symbols, n_dup_lines, n_repeat_words


def _judged(lang: str | None, text: bytes | None, references: dict[str | None, Reference]) -> tuple:
    tokens = words(text)
    n = len(tokens)
    counts = rule_counts(text or b"", tokens)
    failed = n < LEAST_WORDS or 100 * counts[3] > MOST_REPEATED_PERCENT * n
    characters = common = None
    if (reference := references.get(lang)) is not None:
        if n >= CHARACTER_GUARD:
            characters = distance(character_histogram(text), reference.characters)
        if n >= WORD_GUARD:
            common = distance(reference.words(Counter(map(_vocabulary_word, tokens)), n), reference.counts)
    odd = (characters or 0) > CHARACTER_LIMIT or (common or 0) > WORD_LIMIT
    return n, *counts, failed, not failed and not odd, characters, common


_VERDICT = [
    ("n_words", pa.int64(), "long"),
    ("word_chars", pa.int64(), "long"),
    ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"),
    ("n_repeat_words", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"),
    ("character_distance", pa.float64(), "double"),
    ("word_distance", pa.float64(), "double"),
]


def judge_quality(docs: DataFrame, references: dict[str | None, Reference] | None = None) -> DataFrame:
    """``(doc_id, n_words, word_chars, ..., kept, character_distance, word_distance)``, one row per row of ``docs``.

    ``docs`` has doc_id, lang and text. Null and empty texts have no words and fail the base rules. A distance is null
    below its guard and for a language without reference, and then rejects nothing. Repeated rows give repeated rows; an
    empty table gives none; further columns are left out.
    """
    ready(docs.sparkSession)
    known = language_references(docs) if references is None else references
    schema = pa.schema([("doc_id", pa.int64()), *((n, t) for n, t, _ in _VERDICT)])

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = (
            (name, *_judged(lang, text, known))
            for batch in rows
            for name, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)))
        )
        return batches(judged, schema, 2_000)

    return docs.select("doc_id", "lang", F.col("text").cast("binary")).mapInArrow(
        judge, ", ".join(["doc_id long", *(f"{n} {t}" for n, _, t in _VERDICT)])
    )


def passing(docs: DataFrame, references: dict[str | None, Reference] | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    ready(docs.sparkSession)
    known = language_references(docs) if references is None else references
    lang, text = docs.columns.index("lang"), docs.columns.index("text")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            kept = [_judged(code, body, known)[6] for code, body in zip(batch.column(lang).to_pylist(), texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
