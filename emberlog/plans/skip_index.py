"""Building the bitmaps of :mod:`emberlog.sources.skipping` for files of the log table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import LOG_TABLE_SCHEMA
from emberlog.session import prepare
from emberlog.sources.files import child_names
from emberlog.sources.skipping import ATTRIBUTE, BITMAP, FILE, TEXT, TEXT_BITS, attribute_places, skip_path, trigram_places
from emberlog.sources.tables import stored_days

_PLACE = ["event_date", "batch_id", "file_path"]
_BITMAPS = "event_date date, batch_id long, file_path string, block int, bitmap binary"
#: Files whose bitmaps a task holds before it hands them on.
_MOST_FILES = 32


def _bitmaps_of(places: Callable[[np.ndarray], np.ndarray], bits: int, width: int, most: int) -> Callable:
    """Bitmaps of the messages' trigrams by file; a task reads one or a few files, one after the other."""
    schema = pa.schema(
        [("event_date", pa.date32()), ("batch_id", pa.int64()), ("file_path", pa.string()), ("block", pa.int32()), ("bitmap", pa.binary())]
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for place, seen in held.items():
                packed = np.packbits(seen.reshape(-1, width), axis=1, bitorder="little")
                used = np.flatnonzero(packed.any(axis=1))
                columns = [pa.repeat(pa.scalar(x, f.type), len(used)) for x, f in zip(place, schema)]
                bitmaps = pa.array([packed[i].tobytes() for i in used], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(used.astype(np.int32)), bitmaps], schema=schema)
            held.clear()

        for batch in rows:
            names = np.array(batch.column(2).to_pylist(), object)
            for place in set(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                texts = batch.column(3).filter(pa.array(names == place[2])).to_pylist()
                # The messages end to end, two zero bytes between them, so that no trigram of two messages is looked up.
                seen = held.setdefault(place, np.zeros(bits, bool))
                seen[places(np.frombuffer(b"\0\0".join(texts), np.uint8))] = True
            if len(held) > most:
                yield from handed_on()
        yield from handed_on()

    return run


def file_bitmaps(rows: DataFrame) -> DataFrame:
    """``(file_path, kind, block, bitmap, event_date, batch_id)`` of every file that ``rows``, a scan, reads."""
    placed = rows.select("event_date", "batch_id", F.col("_metadata.file_path").alias("file_path"), "message", "attr_text")
    run = _bitmaps_of(trigram_places, TEXT_BITS, BITMAP, _MOST_FILES)
    files = placed.select(*_PLACE).distinct()
    texts = placed.select(*_PLACE, F.lower("message").cast("binary").alias("text")).mapInArrow(run, _BITMAPS)
    texts = texts.groupBy(*_PLACE, "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    pairs = placed.select(*_PLACE, F.explode("attr_text"))
    places = pairs.select(*_PLACE, F.explode(F.array(*attribute_places(F.col("key"), F.col("value")))).alias("place")).distinct()
    block = F.expr(f"cast(place div {BITMAP} as int)").alias("block")
    attributes = places.groupBy(*_PLACE, block).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(BITMAP - 1)).alias("bitmap"))
    columns = ["file_path", "kind", "block", "bitmap", "event_date", "batch_id"]
    return (
        files.select("*", F.lit(FILE).alias("kind"), F.lit(0).alias("block"), F.lit(None).cast("binary").alias("bitmap")).select(*columns)
        .union(texts.withColumn("kind", F.lit(TEXT)).select(*columns))
        .union(attributes.withColumn("kind", F.lit(ATTRIBUTE)).select(*columns))
    )


def index_files(spark: SparkSession, path: str, days: list[date] | None = None, batch_id: int | None = None) -> None:
    """Index the files of these days and this batch (all by default) of the log table at ``path``.

    Running it again replaces what it wrote. Paths are never used twice, so bitmaps of files that are gone do no harm.
    """
    base, folders = path.rstrip("/"), []
    for day in stored_days(spark, base) if days is None else days:
        folder = f"{base}/event_date={day.isoformat()}"
        there = child_names(spark, folder)
        if batch_id is None:
            folders += [folder] if there else []
        elif f"batch_id={batch_id}" in there:
            folders.append(f"{folder}/batch_id={batch_id}")
    if not folders:
        return
    rows = prepare(spark).read.schema(LOG_TABLE_SCHEMA).option("basePath", base).parquet(*folders)
    (
        file_bitmaps(rows)
        .repartition("event_date", "batch_id", "file_path")
        .sortWithinPartitions("event_date", "batch_id", "kind", "block")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "batch_id")
        .parquet(skip_path(base))
    )
