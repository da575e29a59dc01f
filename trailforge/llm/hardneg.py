"""Hard negatives by product quantisation with rigorous bounds.

Vectors of integers are cut into subspaces of ``sub`` components. Each subspace has a codebook of up to 256
centroids (k-means on the ``sample`` rows with the least hashes of vec_id; every row is indexed), and a row is stored
with its codes and the norm of its residual, what the centroids leave. An anchor's inner product with a row is the sum over its lookup tables,
one for each subspace, plus its product with the residual, which is at most norm times norm. So every row has a lower and an upper bound:

* of the rows of the anchor's label, those whose upper bound reaches the k-th largest lower bound may be positives;
* of the others, those whose bounds meet a positive's window and whose upper bound reaches the k-th largest lower bound of the rows that lie in
  the window for sure may be its negatives.

These candidates are ranked by their exact integer products. Bounds are rigorous, so results are those of a full scan: the recall is 1 by
construction, whatever the codebooks are like. Rows are dealt into slabs of about ``slab_bytes`` by a hash of vec_id, anchors into blocks; a slab meets a
block in one task, which keeps k rows for each anchor or window, and the best of all slabs are merged. No group grows with a label or a common vector.

Defined results: rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take no part, nor do
vectors of another length than the most common one (the smaller, if two are). Of rows with one vec_id the least by label and vector counts.
Ties go to the smaller vec_id. Empty tables, or anchors without a positive, give no rows. Products that a long can't hold are
an error. Columns beyond the three are not read, so they can't clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, store, tables, tidily

CENTROIDS = 256
POSITIVES = ("anchor_id", "positive_id", "positive_score")
NEGATIVES = (*POSITIVES, "negative_id", "negative_score")


def finite(vector: Column) -> Column:
    """Whether a vector is there, with components that are all numbers."""
    each = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & each, F.lit(False))


def codebooks(points: np.ndarray, sub: int, steps: int = 8, seed: int = 11) -> list[np.ndarray]:
    """The centroids of each subspace."""
    rng, out = np.random.default_rng(seed), []
    for at in range(0, points.shape[1], sub):
        x = points[:, at : at + sub].astype(float)
        c = np.unique(x, axis=0)
        if len(c) > CENTROIDS:
            c = c[rng.choice(len(c), CENTROIDS, replace=False)]
            for _ in range(steps):
                near = _nearest(x, c)
                n = np.bincount(near, minlength=len(c))
                sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def encode(x: np.ndarray, books: list[np.ndarray], sub: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual norms of rows."""
    codes = np.empty((len(x), len(books)), np.uint8)
    rest = np.zeros(len(x))
    for m, c in enumerate(books):
        part = x[:, m * sub : (m + 1) * sub].astype(float)
        codes[:, m] = _nearest(part, c)
        rest += ((part - c[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(rest)


def _ints(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


class Slab:
    """The indexed rows of one slab, by label and vec_id."""

    def __init__(self, table, books: list[np.ndarray], sub: int, dim: int):
        label, ids = (np.asarray(table.column(c), np.int64) for c in ("label", "vec_id"))
        order = np.lexsort((ids, label))
        self.label, self.ids, self.x = label[order], ids[order], _ints(table.column("vector"), dim)[order]
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
        self.codes = np.ascontiguousarray(codes[order].T)
        self.rest, self.books, self.sub = np.asarray(table.column("rest"), float)[order], books, sub
        self.most = float(np.sqrt((self.x.astype(float) ** 2).sum(1).max())) if len(order) else 0.0

    def same(self, label: int) -> tuple[int, int]:
        """The place of a label's rows."""
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))

    def bounds(self, q: np.ndarray, places: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of q with the rows at some places."""
        q = q.astype(float)
        tables_ = [c @ q[m * self.sub : (m + 1) * self.sub] for m, c in enumerate(self.books)]
        est = np.zeros(sum(p.stop - p.start for p in places))
        for m, table in enumerate(tables_):
            est += np.concatenate([table[self.codes[m, p]] for p in places])
        norm = math.sqrt(float(q @ q))
        slack = norm * np.concatenate([self.rest[p] for p in places]) * (1 + 1e-9) + 1e-9 * (norm * self.most + 1)  # with room for rounded sums
        return est - slack, est + slack

    def top(self, rows: np.ndarray, q: np.ndarray, k: int, low: int | None = None, high: int | None = None, keep: int = 100) -> list[tuple[int, int]]:
        """(score, vec_id) of the first k rows by exact products, within low <= keep * score <= high if these are given."""
        s = self.x[rows] @ q
        if low is not None:
            inside = (keep * s >= low) & (keep * s <= high)
            rows, s = rows[inside], s[inside]
        order = np.lexsort((self.ids[rows], -s))[:k]
        return [(int(s[i]), int(self.ids[rows[i]])) for i in order]

    def positives(self, anchor: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        lo, hi = self.same(label)
        rows = np.arange(lo, hi)
        other = self.ids[lo:hi] != anchor
        rows = rows[other]
        if len(rows) > k:
            low, up = (b[other] for b in self.bounds(q, [slice(lo, hi)]))
            rows = rows[up >= np.partition(low, len(low) - k)[len(low) - k]]
        return self.top(rows, q, k)

    def negatives(self, label: int, q: np.ndarray, scores: list[int], k: int, window: tuple[int, int]) -> dict[int, list[tuple[int, int]]]:
        """The first k rows of other labels in the window of each positive score."""
        lo, hi = self.same(label)
        places = [slice(0, lo), slice(hi, len(self.ids))]
        rows = np.concatenate([np.arange(p.start, p.stop) for p in places])
        if not len(rows):
            return {}
        low, up = self.bounds(q, places)
        out = {}
        for p in scores:
            first, last = window[0] * p / 100, window[1] * p / 100
            may = (up >= first) & (low <= last)
            sure = low[(low >= first) & (up <= last)]
            if len(sure) >= k:
                may &= up >= np.partition(sure, len(sure) - k)[len(sure) - k]
            out[p] = self.top(rows[may], q, k, window[0] * p, window[1] * p)
        return out


class PqIndex:
    """Rows (vec_id, label, vector of longs) with codes and residual norms, stored; the codebooks go with the tasks."""

    def __init__(self, rows: DataFrame, sub: int = 2, sample: int = 8192, slab_bytes: int = 4 << 20, block: int = 4096):
        spark = rows.sparkSession
        bound_batches(spark)
        named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
        named = named.where("vec_id is not null and label is not null and size(vector) > 0 and not exists(vector, x -> x is null)")
        one = store(named.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector"), "pq-rows")
        sizes = one.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double"))))).alias("most"))
        common = sizes.orderBy(F.desc("n"), "dim").first()
        self.dim, n = (common.dim, common.n) if common else (1, 0)
        if common and 100 * self.dim * common.most**2 >= 2.0**62:
            raise ValueError("inner products of these vectors do not fit a long")
        one = one.where(F.size("vector") == self.dim)
        fit = one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
        self.sub, self.block = sub, block
        self.books = codebooks(np.array([r.vector for r in fit], np.int64).reshape(-1, self.dim), sub) if fit else []
        self.slabs = max(1, -(-n * self.dim * 8 // slab_bytes))
        books, dim = self.books, self.dim

        def coded(batches):
            import pyarrow as pa

            for b in batches:
                codes, rest = encode(_ints(b.column("vector"), dim), books, sub)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], names=[*b.schema.names, "codes", "rest"])

        self.rows = store(one.mapInArrow(tidily(coded), "vec_id long, label long, vector array<long>, codes binary, rest double"), "pq-index")

    def _meet(self, asked: DataFrame, work, columns: tuple[str, ...]) -> DataFrame:
        """Rows of longs: work(slab, vector, row) for every slab and every row of asked (anchor_id, label, vector, ..)."""
        blocks = max(1, -(-asked.count() // self.block))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = self.rows.withColumn("slab", F.pmod(F.xxhash64("vec_id"), F.lit(self.slabs)).cast("int")).withColumn("block", every(blocks))
        right = asked.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")).withColumn("slab", every(self.slabs))
        books, sub, dim = self.books, self.sub, self.dim

        def run(a, b):
            import pyarrow as pa

            found = []
            if a.num_rows and b.num_rows:
                slab = Slab(a, books, sub, dim)
                found = [r for row in zip(_ints(b.column("vector"), dim), b.drop_columns(["vector"]).to_pylist(), strict=True) for r in work(slab, *row)]
            return pa.table([pa.array([r[i] for r in found], pa.int64()) for i in range(len(columns))], names=list(columns))

        return left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(run, ", ".join(f"{c} long" for c in columns))

    def mine(self, anchors: DataFrame, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
        """The first negatives of each of the first positives of each anchor (vec_id): rows of other labels whose score is within
        window per cent of the positive's score. (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)"""
        asked = store(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(self.rows, "vec_id").select(F.col("vec_id").alias("anchor_id"), "label", "vector"), "pq-anchors")

        def near(slab, q, row):
            return [(row["anchor_id"], i, s) for s, i in slab.positives(row["anchor_id"], row["label"], q, positives)]

        def far(slab, q, row):
            found = slab.negatives(row["label"], q, sorted({p["positive_score"] for p in row["positives"]}), negatives, window)
            return [(row["anchor_id"], p["positive_id"], p["positive_score"], i, s) for p in row["positives"] for s, i in found.get(p["positive_score"], [])]

        nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
        best = self._meet(asked, near, POSITIVES).withColumn("nth", nth).where(F.col("nth") <= positives)
        best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most the wanted number
        known = store(asked.join(best, "anchor_id"), "pq-positives")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
        out = self._meet(known, far, NEGATIVES).withColumn("rank", rank).where(F.col("rank") <= negatives)
        return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def prepared(embeddings: DataFrame, scale: int = 256, moved: int = 7) -> DataFrame:
    """(vec_id, label, vector): components as floor(scale * x); the label of every moved-th row is the next of ten."""
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.where(F.col("label").isNotNull() & finite(vector))
    return rows.select("vec_id", label.alias("label"), F.transform(vector, lambda x: F.floor(scale * x)).alias("vector"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = prepared(tables(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return PqIndex(rows).mine(rows.where("vec_id % 100 = 0"))


OP11_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
