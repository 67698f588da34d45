"""Files that cannot hold a match, known from small bitmaps kept beside the table.

Of every indexed data file the table ``_skip`` has the trigrams of its lower-cased messages and its attribute pairs, as
bits of hashes. A search turns the literal pieces of its text pattern and its attribute values into bits; a file without
one of them is left out of the scan. Files that are not indexed are always read, so a missing or late index costs time
and never a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import literal_pieces
from emberlog.session import prepare
from emberlog.sources.files import child_names

#: Kinds of row: the file itself, a bitmap of trigrams, a bitmap of attributes.
FILE, TEXT, ATTRIBUTE = 0, 1, 2
#: Bits of a file's trigrams and of its attribute pairs; only bitmaps with a bit set are stored. A pair sets two bits.
TEXT_BITS, ATTRIBUTE_BITS = 1 << 18, 1 << 22
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15

SKIP_SCHEMA = "file_path string, kind int, block int, bitmap binary, event_date date, batch_id long"


def skip_path(path: str) -> str:
    return f"{path.rstrip('/')}/_skip"


def _trigrams(shift: int) -> Callable[[np.ndarray], np.ndarray]:
    # Made in a function, like all that runs in Python workers, so that they need not find this package.
    def places(text: np.ndarray) -> np.ndarray:
        """The bit of every three bytes that follow each other."""
        wide = text.astype(np.uint32)
        if len(wide) < 3:
            return wide[:0]
        codes = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(shift)

    return places


trigram_places = _trigrams(32 - TEXT_BITS.bit_length() + 1)


def attribute_places(key: Column, value: Column) -> list[Column]:
    """The two bits of an attribute."""
    mark = F.xxhash64(key, value)
    return [mark.bitwiseAND(ATTRIBUTE_BITS - 1), F.shiftrightunsigned(mark, 32).bitwiseAND(ATTRIBUTE_BITS - 1)]


def text_probes(q: str) -> set[int]:
    """Bits that a file needs for a match of the pattern. Only plain ASCII counts: its lower case is the same anywhere."""
    found: set[int] = set()
    for piece in literal_pieces(q):
        for run in "".join(c if c.isascii() else "\0" for c in piece).split("\0"):
            found.update(trigram_places(np.frombuffer(run.lower().encode(), np.uint8)).tolist())
    return found


def attribute_probes(spark: SparkSession, attrs: Mapping[str, str]) -> set[int]:
    """Bits that a file needs for a row with all these attributes. A local relation, folded on the driver."""
    if not attrs:
        return set()
    pairs = spark.createDataFrame(pa.table({"key": pa.array(attrs.keys(), pa.string()), "value": pa.array(attrs.values(), pa.string())}))
    places = pairs.select(*attribute_places(F.col("key"), F.col("value"))).collect()
    return {place for row in places for place in row}


def _folders(spark: SparkSession, path: str, days: list[date] | None) -> list[str]:
    base = skip_path(path)
    there = {name for name in child_names(spark, base) if name.startswith("event_date=")}
    if days is None:
        return [base] if there else []
    return [f"{base}/event_date={day.isoformat()}" for day in days if f"event_date={day.isoformat()}" in there]


def read_index(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame | None:
    folders = _folders(spark, path, days)
    if not folders:
        return None
    return prepare(spark).read.schema(SKIP_SCHEMA).option("basePath", skip_path(path)).parquet(*folders)


def _bit(place: int) -> Column:
    """Whether the row's bitmap has this bit."""
    within = place % BITMAP
    byte = F.conv(F.hex(F.substring("bitmap", within // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(F.lit(1 << within % 8)) != 0


#: The bits a file needs, by kind and bitmap.
Probes = Mapping[tuple[int, int], list[int]]


def probes(spark: SparkSession, q: str | None, attrs: Mapping[str, str]) -> Probes:
    """What a match of the pattern and the attributes needs; empty if nothing can be looked up."""
    wanted: dict[tuple[int, int], list[int]] = defaultdict(list)
    for kind, places in ((TEXT, text_probes(q) if q else set()), (ATTRIBUTE, attribute_probes(spark, attrs))):
        for place in places:
            wanted[kind, place // BITMAP].append(place)
    return wanted


def excluded_files(
    spark: SparkSession, path: str, days: list[date] | None, q: str | None, attrs: Mapping[str, str]
) -> list[str]:
    """Paths of the indexed files (of these days) that no match can be in; at most as many as the scan would list."""
    return files_without(spark, path, days, probes(spark, q, attrs))


def files_without(spark: SparkSession, path: str, days: list[date] | None, wanted: Probes) -> list[str]:
    """:func:`excluded_files` for probes made before: one job over the few bitmaps that may hold a wanted bit."""
    index = read_index(spark, path, days) if wanted else None
    if index is None:
        return []
    rows, found = F.col("kind") == FILE, F.lit(0)
    for (kind, block), places in sorted(wanted.items()):
        own = (F.col("kind") == kind) & (F.col("block") == block)
        rows = rows | own
        for place in places:
            found = found + F.when(own & _bit(place), 1).otherwise(0)
    total = sum(map(len, wanted.values()))
    held = index.where(rows).groupBy("file_path").agg(F.sum(found).alias("held")).where(F.col("held") < total)
    return held.select("file_path").toArrow().column("file_path").to_pylist()
