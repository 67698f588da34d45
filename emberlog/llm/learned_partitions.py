"""Nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into parts of equal size; a small network learns to tell, from a vector, in
which parts its neighbours lie. Every vector is stored under its likeliest part, every query goes to its several
likeliest parts, and the vectors found there are ranked by their exact distance. The number of parts a query goes to is
the least with which the sample's own neighbours are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import ready
from emberlog.session import materialise

#: The network is fitted on this many vectors at most, those with the smallest hashes of their ids.
SAMPLE = 6_000
#: Vectors a part is meant to hold, and the most parts a sample of that size can tell apart.
PART_VECTORS = 4_000
MOST_PARTS = 128
#: Neighbours of the graph, and the share of them that the probed parts must hold in the sample.
GRAPH_NEIGHBOURS = 10
TARGET = 0.985
#: Vectors and queries that meet in one task at most.
BLOCK = 20_000


def _nearest(points: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` nearest other points of each point."""
    norms, found = (points**2).sum(axis=1), []
    for start in range(0, len(points), 1_000):
        some = slice(start, start + 1_000)
        away = norms[some, None] - 2 * points[some] @ points.T + norms
        away[np.arange(len(away)), np.arange(start, start + len(away))] = np.inf
        found.append(np.argpartition(away, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The graph in ``parts`` (a power of two) of equal size: halved again and again at the median of its second eigenvector."""
    rng, count = np.random.default_rng(seed), len(neighbours)
    part = np.zeros(count, np.int64)
    a = np.repeat(np.arange(count), neighbours.shape[1])
    b = neighbours.ravel()
    done = 1
    while done < parts:
        inside = part[a] == part[b]
        u, v = np.concatenate([a[inside], b[inside]]), np.concatenate([b[inside], a[inside]])
        degree = np.bincount(u, minlength=count) + 1e-9
        x = rng.standard_normal(count)
        size = np.bincount(part, weights=degree, minlength=done)
        for _ in range(60):
            x -= (np.bincount(part, weights=degree * x, minlength=done) / size)[part]
            x = 0.5 * x + 0.5 * np.bincount(u, weights=x[v], minlength=count) / degree
            x /= np.sqrt(np.bincount(part, weights=x * x, minlength=done) + 1e-30)[part]
        order = np.lexsort((x, part))
        held = np.bincount(part, minlength=done)
        rank = np.empty(count, np.int64)
        rank[order] = np.arange(count) - np.repeat(np.cumsum(held) - held, held)
        part = 2 * part + (rank >= (held[part] + 1) // 2)
        done *= 2
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; without weights everything is in the one part there is."""

    center: np.ndarray
    scale: float
    weights: tuple[np.ndarray, ...]
    probes: int

    def scores(self, points: np.ndarray) -> np.ndarray:
        x = (points - self.center) / self.scale
        if not self.weights:
            return np.zeros((len(points), 1))
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    @property
    def parts(self) -> int:
        return self.weights[3].shape[0] if self.weights else 1


def fit(points: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 0) -> Router:
    """The router for a sample of vectors."""
    center = points.mean(axis=0) if len(points) else np.zeros(0)
    scale = float(points.std()) or 1.0 if len(points) else 1.0
    if parts < 2:
        return Router(center, scale, (), 1)
    neighbours = _nearest(points, min(GRAPH_NEIGHBOURS, len(points) - 1))
    part = balanced_parts(neighbours, parts, seed)
    # The aim for a vector: where it and its neighbours lie.
    aim = np.zeros((len(points), parts))
    np.add.at(aim, (np.repeat(np.arange(len(points)), neighbours.shape[1]), part[neighbours].ravel()), 1.0)
    aim[np.arange(len(points)), part] += 1
    aim /= aim.sum(axis=1, keepdims=True)
    rng, x = np.random.default_rng(seed), (points - center) / scale
    weights = [
        rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
        rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts),
    ]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            inner = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            out = inner @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            off = (out / out.sum(axis=1, keepdims=True) - aim[rows]) / len(rows)
            back = (off @ weights[2].T) * (inner > 0)
            slopes, step = [x[rows].T @ back, back.sum(axis=0), inner.T @ off, off.sum(axis=0)], step + 1
            for i, slope in enumerate(slopes):
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                weights[i] = weights[i] - 0.003 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(center, scale, tuple(weights), parts)
    scores = router.scores(points)
    stored, order = scores.argmax(axis=1), np.argsort(-scores, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(points), axis=0), axis=1)
    needed = np.take_along_axis(rank, stored[neighbours], axis=1)
    held = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    # Later vectors were not in the sample, so one part more than the sample needs.
    return Router(center, scale, router.weights, int(min(parts, np.searchsorted(held, TARGET) + 2)))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with the vectors as doubles: those with finite components, not all zero, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0))
    sizes = whole.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return whole.filter(F.size("v") == F.lit(sizes["size"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ranked(k: int):
    """The nearest candidates of each query within a block, by exact distance."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        points, ids = np.stack(block["v"].to_numpy()), block["vec_id"].to_numpy()
        norms, found = (points**2).sum(axis=1), []
        for start in range(0, len(queries), 200):
            some = queries.iloc[start : start + 200]
            q = np.stack(some["v"].to_numpy())
            q_norms = (q**2).sum(axis=1)
            away = q_norms[:, None] - 2 * q @ points.T + norms
            own = some["vec_id"].to_numpy()[:, None] == ids[None, :]
            away[own] = np.inf
            width = min(k, len(ids))
            # The fast form rounds, so everything within its error of the k-th distance is ranked exactly.
            bound = np.partition(away, width - 1, axis=1)[:, width - 1] + 1e-9 * (q_norms + norms.max() + 1)
            for i, query in enumerate(some["vec_id"].to_numpy()):
                near = np.flatnonzero((away[i] <= bound[i]) & ~own[i])
                exact = np.sqrt(((points[near] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], exact))[:k]
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(found, ignore_index=True)

    return run


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row for which ``is_query`` holds.

    ``vectors`` has vec_id and embedding. Null or zero vectors, and such with a null or non-finite component or another
    length than most, take no part. A query is no candidate of its own; equal distances go to the smaller vec_id. Fewer
    candidates than ``k`` give fewer rows; an empty table gives none; further columns are left out.
    """
    spark = ready(vectors.sparkSession)
    whole = usable(vectors).filter(F.col("vec_id").isNotNull())
    # Of equal vectors only the k + 1 with the smallest ids can be among anyone's nearest.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = materialise(whole.withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy"), "vectors")
    count = candidates.count()
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    points = np.array([r["v"] for r in sample], dtype=np.float64)
    parts = 1
    while parts * PART_VECTORS < count and parts < MOST_PARTS and 20 * parts <= len(points):
        parts *= 2
    router = spark.sparkContext.broadcast(fit(points, parts))

    def stored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            part = router.value.scores(_matrix(batch.column(1))).argmax(axis=1) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], names=["vec_id", "v", "part"])

    def routed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            order = np.argsort(-router.value.scores(_matrix(batch.column(1))), axis=1)[:, : router.value.probes] if len(batch) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v", "parts"])

    index = materialise(candidates.mapInArrow(stored, "vec_id long, v array<double>, part long"), "vector-parts")
    asked = whole.filter(is_query).dropDuplicates(["vec_id"]).mapInArrow(routed, "vec_id long, v array<double>, parts array<long>")
    asked = materialise(asked.select("vec_id", "v", F.explode("parts").alias("part")), "vector-queries")
    # One row per part: into how many blocks its vectors and its queries are cut.
    sizes = index.groupBy("part").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    loads = asked.groupBy("part").count().withColumn("shifts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")

    def spread(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    cut = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    turn = F.pmod(F.xxhash64("vec_id"), F.col("shifts")).cast("int")
    both = sizes.join(loads, "part")
    left = asked.join(both, "part").select("part", spread("blocks").alias("block"), turn.alias("shift"), "vec_id", "v")
    right = index.join(both, "part").select("part", cut.alias("block"), spread("shifts").alias("shift"), "vec_id", "v")
    keys = ["part", "block", "shift"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_ranked(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
