"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch


def smallest_in_component(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of every end of ``edges`` (u, v): the smallest id in its component.

    Each round hooks the larger neighbours of a node to the smallest id around it, then all its smaller neighbours too;
    a node with many neighbours is one partial aggregation. The number of rounds grows with the logarithm of the longest
    path. The table of a round replaces the one before.
    """
    now, mark = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", "low"))
        before, now = now, scratch.write(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        scratch.spent(before)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            own = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            found = scratch.write(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(own), "components")
            scratch.spent(now)
            return found
        mark = seen


def labels_nearby(edges: DataFrame, hops: int = 3) -> DataFrame:
    """``(id, label)`` of every end of ``edges`` (u, v): the smallest id within ``hops`` edges and one.

    Ids with one label are in one component; the converse need not hold. One job's work, where components take several.
    """
    both = edges.select("u", "v").union(edges.select("v", "u"))
    label = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("id"), F.least("u", "low").alias("label"))
    for _ in range(hops):
        beside = both.join(label.withColumnRenamed("id", "v"), "v")
        label = beside.groupBy("u").agg(F.min("label").alias("label")).withColumnRenamed("u", "id")
    return label
