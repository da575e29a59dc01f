"""Approximate nearest neighbours: a forest of random-projection trees.

Distinct vectors are dealt into slabs of about ``slab_rows`` by a hash. Each slab has a forest of
its own, fitted on all of its vectors: each node splits at the median of its level's random
projection, down to leaves of about ``leaf_rows``. Queries go to every slab, in blocks. There a query
walks all trees with one shared priority queue, ordered by the largest distance to a
split it had to cross, and visits the ``probe_share`` nearest leaves (``least_probes`` at
least). The candidates, each taken once, are reranked by the exact cosine of
the original vectors in double precision, and the best of all slabs are kept.

So a vector is sent once for each block of ``query_block`` queries, a task's memory does not depend on the
number of vectors, no sample is taken, and recall does not fall as the table grows. Equal vectors are one
vector with the k + 1 smallest of their identifiers, which are picked before the shuffle; so a
vector that a third of all rows share is one row here.

Defined results: null, zero or non-finite vectors, null identifiers, and
vectors of another length than the most common one take no part; repeated equal
rows count once; of equal scores the smaller identifier comes first; an empty table gives no rows; columns
beyond vec_id and embedding are not read, so their names can't clash. Every slab is searched by its forest, however small;
one of at most ``leaf_rows`` vectors is a single leaf.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, store, tables, tidily


def fit_forest(points: np.ndarray, trees: int, depth: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(directions of the levels, thresholds of the nodes in heap order, leaf of each point) of each tree; points are unit rows.

    The nodes of a level share one direction, so a query is projected once a level, not once a node; the directions of a tree are
    orthogonal as far as there are dimensions.
    """
    forest = []
    for t in range(trees):
        w = np.random.default_rng([seed, t]).standard_normal((depth, points.shape[1]))
        for i in range(0, depth, points.shape[1]):
            w[i : i + points.shape[1]] = np.linalg.qr(w[i : i + points.shape[1]].T)[0].T
        w = w.astype(np.float32)
        along = points @ w.T
        b = np.zeros((1 << depth) - 1, np.float32)
        where = np.zeros(len(points), np.int64)
        for level in range(depth):
            first, p = (1 << level) - 1, along[:, level]
            order = np.lexsort((p, where))
            cuts = np.searchsorted(where[order], np.arange(first, 2 * first + 2))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            b[first + full] = p[order[(cuts[full] + cuts[full + 1]) // 2]]
            where = 2 * where + 1 + (p >= b[where])
        forest.append((w, b, where - ((1 << depth) - 1)))
    return forest


def probe(along: list[list[float]], thresholds: list[list[float]], depth: int, probes: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs of one query, nearest first, from its projections on the levels of each tree: margins are taken at the nodes it comes to."""
    inner = (1 << depth) - 1
    heap = [(0.0, t, 0, 0) for t in range(len(thresholds))]
    found: list[tuple[int, int]] = []
    while heap and len(found) < probes:
        worst, t, node, level = heapq.heappop(heap)
        p, b = along[t], thresholds[t]
        while node < inner:
            m = p[level] - b[node]
            level += 1
            near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(heap, (max(worst, abs(m)), t, far, level))
            node = near
        found.append((t, node - inner))
    return found


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite and not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def cosine_rows(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosine of each row with one vector, in double precision, summed in the same way for every row."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt(float((q * q).sum())))


class Slab:
    """The vectors of one slab and their forest."""

    def __init__(self, x: np.ndarray, trees: int, leaf_rows: int, probe_share: float, least_probes: int):
        self.x, unit = x, _unit(x)
        self.depth = max(0, math.ceil(math.log2(len(x) / leaf_rows)))  # 0: one leaf of all vectors
        forest = fit_forest(unit, trees, self.depth)
        self.probes = max(least_probes, math.ceil(probe_share * trees * (1 << self.depth)))
        self.directions = np.concatenate([w for w, _, _ in forest])
        self.thresholds = [b.tolist() for _, b, _ in forest]
        self.order = [np.argsort(leaf, kind="stable") for _, _, leaf in forest]
        self.begin = [np.searchsorted(leaf[order], np.arange((1 << self.depth) + 1)) for (_, _, leaf), order in zip(forest, self.order, strict=True)]

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """The numbers of the vectors in the leaves that the query visits."""
        along = (self.directions @ _unit(q[None])[0]).reshape(len(self.order), self.depth).tolist()
        met = np.zeros(len(self.x), bool)
        for t, leaf in probe(along, self.thresholds, self.depth, self.probes):
            met[self.order[t][self.begin[t][leaf] : self.begin[t][leaf + 1]]] = True
        return np.flatnonzero(met)

    def best(self, q: np.ndarray, most: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the best candidates; of equal scores those with the smaller key."""
        own = self.candidates(q)
        s = cosine_rows(self.x[own], q)
        if len(own) > most:
            near = s >= np.partition(s, len(s) - most)[len(s) - most]  # all that tie with the last one
            own, s = own[near], s[near]
        top = np.lexsort((keys[own], -s))[:most]
        return own[top], s[top]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, trees: int = 64, leaf_rows: int = 32, probe_share: float = 0.008, least_probes: int = 128, slab_rows: int = 16_384, query_block: int = 20_000) -> DataFrame:
    """The k nearest of each query: query_id, rank, vec_id, score. Both tables have vec_id and embedding."""
    bound_batches(rows.sparkSession)
    named = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = named(rows)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = common[0].n if common else 1
    rows = rows.where(F.size("embedding") == dim)
    queries = named(queries).where(F.size("embedding") == dim).distinct()

    # the rank is also taken before the shuffle, so copies don't gather
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    copies = rows.withColumn("nth", F.dense_rank().over(by_id)).where(f"nth <= {k + 1}").groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    vectors = store(copies.withColumn("vkey", F.monotonically_increasing_id()), "vectors")
    asked = store(queries.withColumn("qkey", F.monotonically_increasing_id()), "queries")
    slabs = max(1, math.ceil(vectors.count() / slab_rows))
    blocks = max(1, math.ceil(asked.count() / query_block))

    def rerank(left, right):
        import pyarrow as pa

        x, y = _matrix(left.column("embedding")), _matrix(right.column("embedding"))
        schema = pa.schema([("qkey", pa.int64()), ("vkey", pa.int64()), ("score", pa.float64())])
        if not len(x) or not len(y):
            return schema.empty_table()
        vkey, first, qkey = np.asarray(left.column("vkey")), np.asarray(left.column("first")), np.asarray(right.column("qkey"))
        slab = Slab(x, trees, leaf_rows, probe_share, least_probes)
        found = [slab.best(q, k + 1, first) for q in y]
        columns = [np.repeat(qkey, [len(i) for i, _ in found]), vkey[np.concatenate([i for i, _ in found])], np.concatenate([s for _, s in found])]
        return pa.table([pa.array(c) for c in columns], schema=schema)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vkey", "embedding", F.element_at("ids", 1).alias("first"), F.pmod(F.xxhash64("embedding"), F.lit(slabs)).cast("int").alias("slab"), every(blocks).alias("block"))
    right = asked.select("qkey", "embedding", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int").alias("block"), every(slabs).alias("slab"))
    pairs = left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(rerank, "qkey long, vkey long, score double")
    hits = pairs.join(vectors.select("vkey", F.explode("ids").alias("vec_id")), "vkey").join(asked.select("qkey", F.col("vec_id").alias("query_id")), "qkey").where("vec_id <> query_id")
    nth = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", nth).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
