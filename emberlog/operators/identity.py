"""Dense row numbers over data of any size, without a global single-task window.

Both forms cut the data into *lanes* that are each numbered by one task, count the rows of every lane, and add
the running total of the earlier lanes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import materialise

#: Ids are ``batch_id`` in the upper bits and the arrival index within the batch in the lower ones.
INDEX_BITS = 33


def number_lanes(df: DataFrame, lane: list[str], sequence: str, name: str) -> DataFrame:
    """Add ``name``: 0-based position when lanes follow each other in key order.

    Within a lane ``sequence`` must rise by one per row. There is one lane per input split or shuffle partition,
    so the lane table is plan-sized, not data-sized. It becomes a local relation of exact size: the planner
    broadcasts it below its own threshold and shuffles beyond it.
    """
    lanes = (
        df.groupBy(*lane)
        .agg(F.count("*").alias("_rows"), F.min(sequence).alias("_first"))
        .orderBy(*lane)
    )
    table = lanes.toArrow()
    running, offsets = 0, []
    for rows in table.column("_rows").to_pylist():
        offsets.append(running)
        running += rows
    table = table.append_column("_offset", pa.array(offsets, pa.int64())).drop_columns(["_rows"])
    offset = df.sparkSession.createDataFrame(table)
    position = F.col("_offset") + F.col(sequence) - F.col("_first")
    return df.join(offset, lane).withColumn(name, position).select(*df.columns, name)


def dense_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Add ``name``: 0-based position of every row in the total order ``order``.

    One range shuffle (a hot leading key is split by the later keys), one columnar write to the shared folder that
    freezes each row's partition and place, and a count that reads only those two columns.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_lane", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialise(ranged, "ordered")
    return number_lanes(stored, ["_lane"], "_place", name).drop("_lane", "_place")


def batch_row_id(batch_id: int, index: Column) -> Column:
    """Unique, batch-monotonic id from a dense arrival index; fails rather than run into the next batch."""
    base = F.lit(batch_id << INDEX_BITS).cast("long")
    return F.when(index < F.lit(1 << INDEX_BITS), base + index).otherwise(
        F.raise_error(F.lit("batch holds too many rows for its id range"))
    )


def assign_ids(df: DataFrame, batch_id: int, order: list[Column]) -> DataFrame:
    """Add ``id`` in arrival order. The same rows get the same ids when a batch is replayed."""
    indexed = dense_index(df, order, "_index")
    return indexed.withColumn("id", batch_row_id(batch_id, F.col("_index"))).drop("_index")


def assign_ids_by_split(df: DataFrame, batch_id: int, lane: list[str], sequence: str) -> DataFrame:
    """As :func:`assign_ids` for rows that still sit in the order their file splits were read: no shuffle.

    ``lane`` orders the splits by arrival, ``sequence`` the rows of one split.
    """
    indexed = number_lanes(df, lane, sequence, "_index")
    return indexed.withColumn("id", batch_row_id(batch_id, F.col("_index"))).drop("_index")
