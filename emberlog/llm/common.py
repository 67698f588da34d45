"""What the operators of this subpackage share: reading tables, batch sizes, word splitting, row packing."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import prepare, scratch_path
from emberlog.sources.files import delete

#: A word, for every operator: a run without blank and without the five ASCII controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows and bytes of a batch that a Python worker gets: whole texts, so few rows.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "200",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def ready(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches small enough for long texts."""
    prepare(spark)
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The row as one struct ``row`` beside computed columns, so that no column of the input can clash with them."""
    return docs.select(F.struct(*(docs[f"`{name}`"] for name in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text as UTF-8: ``bytes.split`` cuts at exactly the characters that :data:`WORD` leaves out."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Scratch:
    """Tables in the shared folder that are deleted once they are spent."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back, as :func:`emberlog.session.materialise` does."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def free_shuffles(self) -> None:
        """Let Spark delete the shuffle files of jobs that are over, whose tables are written: it does so when the driver
        collects garbage, which on a large heap may take long after the disks are full."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def spent(self, *tables: DataFrame) -> None:
        """Nothing will read these tables again."""
        for table in tables:
            delete(self.spark, self.paths.pop(id(table))[1])


#: Bits per key in the bitmap that rows are looked up in, and the most bits it may have: 512 MB. Up to 2^28 different
#: keys it lets one in sixteen of the other rows through, beyond that more of them; it never holds a wanted one back.
LOOKUP_BITS = 16
MOST_LOOKUP_BITS = 1 << 32
#: Bits of one of Spark's bitmaps.
_BITMAP = 1 << 15


def power_of_two(n: int) -> int:
    """The smallest one that is not below ``n``."""
    return 1 << max(0, n - 1).bit_length()


def single_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def looked_up(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose hash ``name`` is one of ``keys``, and a few others: for use before a shuffle of whole texts.

    The keys become bitmaps, which are broadcast: their bound is ``MOST_LOOKUP_BITS``, whatever the number of keys. The
    caller's join or aggregation decides on what is let through.
    """
    bits = min(MOST_LOOKUP_BITS, max(_BITMAP, power_of_two(LOOKUP_BITS * keys.count())))
    place = F.pmod(name, F.lit(bits))
    block, bit = F.shiftright(place, 15), place.bitwiseAND(_BITMAP - 1)
    bitmaps = keys.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    # A byte of the bitmap as a number, then one of its bits.
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    there = byte.bitwiseAND(single_bit(F.col("_bit").bitwiseAND(7).cast("int"))) != 0
    placed = rows.withColumn("_block", block).withColumn("_bit", bit)
    return placed.join(F.broadcast(bitmaps), "_block").filter(there).select(*rows.columns)
