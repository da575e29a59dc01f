"""Late interaction: passages and queries of many vectors, scored by the sum, over a query's vectors, of the largest inner product (MaxSim).

LateIndex is exact. ResidualIndex keeps a centroid and two bits a component of each vector's residual, searches the
nearest centroids' lists with these, and ranks its candidates again with the exact vectors.

Vectors are rows (doc_id, pos, embedding). Those that are null, of another length than the first one's or with a null or
non-finite component take no part; neither do places from ``most_vectors`` on (an encoder's longest passage; None: no limit).
Scores are rounded to ``digits`` before ranking; ties go to the smaller id. All vectors of a passage are in one slab, a few megabytes that
meet a block of queries in one task, so neither side is broadcast or collected, and a task keeps ``top_k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

#: What centroids may take in bytes: they go with every task.
MOST_CENTROID_BYTES = 64 << 20
# The middle cut of the best four-level quantizer of normal numbers, in standard deviations.
CUT = 0.9816


def usable(vectors: DataFrame, most: int | None, key: str = "doc_id") -> DataFrame:
    """(key, pos, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("embedding is not null and size(embedding) > 0").select(key, "pos", v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows if most is None else rows.where(F.col("pos") < most)


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, vs): the vectors of each key, in order; a passage is one row, as its length is bounded."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vs"))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of vectors as one matrix, and where each row's vectors begin (with the end)."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    starts = np.asarray(column.offsets, np.int64)
    inner = column.flatten()
    flat = np.asarray(inner.flatten(), float)
    return flat.reshape(len(inner), -1) if len(inner) else flat.reshape(0, 1), starts - (starts[0] if len(starts) else 0)


def _ids(column) -> np.ndarray:
    return np.array(column.to_pylist())


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, ties by id."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))


def meet(left: DataFrame, key: str, slabs: int, right: DataFrame, blocks: int, work: Callable, schema: str) -> DataFrame:
    """work(rows of a slab, rows of a block) for all slabs (by a hash of left's key) and blocks (by a hash of right's qid)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = left.withColumn("slab", place(key, slabs)).withColumn("block", every(blocks))
    b = right.withColumn("block", place("qid", blocks)).withColumn("slab", every(slabs))
    return a.groupBy("slab", "block").cogroup(b.groupBy("slab", "block")).applyInArrow(work, schema)


def ranked(hits: DataFrame, top_k: int, score: str = "score") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "doc_id"))
    return hits.withColumn("rank", nth).where(F.col("rank") <= top_k)


def with_passages(hits: DataFrame, passages: DataFrame | None) -> DataFrame:
    """Hits with titles and texts, which are empty where there are no passages."""
    if passages is None:
        return hits.withColumns({"title": F.lit(""), "text": F.lit("")})
    found = passages.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return hits.join(found, "doc_id", "left").na.fill("", ["title", "text"])


class LateIndex:
    """Exact top-k by MaxSim. vectors: doc_id, pos, embedding; passages, if given: doc_id, title, text."""

    def __init__(self, vectors: DataFrame, passages: DataFrame | None = None, most_vectors: int | None = 300, digits: int = 5, slab_bytes: int = 8 << 20, block_bytes: int = 1 << 20):
        self.vectors, self.passages, self.most, self.digits, self.slab_bytes, self.block_bytes = vectors, passages, most_vectors, digits, slab_bytes, block_bytes

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """queries: qid, pos, embedding, a row for each vector. (qid, rank, doc_id, title, text, score)"""
        digits = self.digits
        docs, asked = usable(self.vectors, self.most), usable(queries, None, "qid")
        dim, n = _shape(docs)
        m = _shape(asked)[1]
        docs, asked = packed(docs.where(F.size("v") == dim), "doc_id"), packed(asked.where(F.size("v") == dim), "qid")

        def score(a, b):
            import pyarrow as pa

            x, at = _flat(a.column("vs"))
            q, begin = _flat(b.column("vs"))
            ids, qids, found = _ids(a.column("doc_id")), b.column("qid").to_pylist(), []
            for i, qid in enumerate(qids if len(ids) else []):
                best = np.maximum.reduceat(q[begin[i] : begin[i + 1]] @ x.T, at[:-1], axis=1).sum(0).round(digits)
                found += [(qid, ids[j].item(), best[j]) for j in _first(best, ids, top_k)]
            return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((b.column("qid").type, a.column("doc_id").type, pa.float64()))], names=["qid", "doc_id", "score"])

        kind = lambda df, c: df.schema[c].dataType.simpleString()
        hits = meet(docs, "doc_id", _parts(n, dim, self.slab_bytes), asked, _parts(m, dim, self.block_bytes), score, f"qid {kind(asked, 'qid')}, doc_id {kind(docs, 'doc_id')}, score double")
        return with_passages(ranked(hits, top_k), self.passages).select("qid", "rank", "doc_id", "title", "text", "score")


def _shape(rows: DataFrame) -> tuple[int, int]:
    """(length of the first vector, number of vectors)."""
    one = rows.agg(F.min_by(F.size("v"), F.struct(rows.columns[0], "pos")).alias("dim"), F.count("*").alias("n")).first()
    return one.dim or 1, one.n


def _parts(n: int, dim: int, most: int) -> int:
    return max(1, -(-n * dim * 8 // most))


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the first of equal ones."""
    return np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lloyd(rows: DataFrame, centroids: np.ndarray, steps: int) -> np.ndarray:
    """k-means steps over all rows (v): partial sums in each task, added up by Spark; a centroid without rows stays."""
    dim = centroids.shape[1]
    for _ in range(steps):
        c = centroids

        def sums(batches, c=c):
            import pyarrow as pa

            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                x = _rows(b.column("v"))
                near = _near(x, c)
                n += np.bincount(near, minlength=len(c))
                np.add.at(total, near, x)
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["c", "n", "total"])

        parts = rows.select("v").mapInArrow(sums, "c long, n long, total array<double>").select("c", "n", F.posexplode("total").alias("i", "x"))
        centroids = c.copy()
        for r in parts.groupBy("c", "i").agg((F.sum("x") / F.sum("n")).alias("x")).collect():  # a row for each component of a centroid
            centroids[r.c, r.i] = r.x
    assert centroids.shape[1] == dim
    return centroids


class ResidualIndex:
    """A stored index of quantized vectors.

    ``build`` writes centroids (the first distinct vectors, moved by ``steps`` k-means steps over all vectors), codes (slab, centroid, doc_id, pos, and four
    buckets a component packed to two bits, in order of slab and centroid, so that a centroid's list stands together), the exact vectors, and
    the settings: the cut between buckets and the mean residual of each. ``open`` reads it.
    """

    def __init__(self, spark: SparkSession, path: str):
        how = spark.read.parquet(f"{path}/settings").first()
        self.spark, self.path, self.dim, self.slabs, self.cut, self.levels, self.digits, self.n = spark, path, how.dim, how.slabs, how.cut, np.array(how.levels), how.digits, how.n
        rows = spark.read.parquet(f"{path}/centroids").orderBy("c").collect()  # size checked when built
        self.centroids = np.array([r.v for r in rows], float).reshape(-1, how.dim)

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, centroids: int = 1024, steps: int = 4, most_vectors: int | None = 300, digits: int = 5, slab_bytes: int = 16 << 20) -> ResidualIndex:
        """slab_bytes: what the vectors of a slab take when they are decoded, which a search does with a slab at a time."""
        spark, rows = vectors.sparkSession, stored(usable(vectors, most_vectors), "late-vectors")
        dim, n = _shape(rows)
        if centroids * dim * 8 > MOST_CENTROID_BYTES:
            raise ValueError(f"{centroids} centroids of {dim} components are more than {MOST_CENTROID_BYTES} bytes")
        rows = rows.where(F.size("v") == dim)
        first = rows.groupBy("v").agg(F.min(F.struct("doc_id", "pos")).alias("at")).orderBy("at").limit(centroids).collect()
        c = lloyd(rows, np.array([r.v for r in first], float).reshape(-1, dim), steps)

        def residuals(batches, c=c):
            for b in batches:
                x = _rows(b.column("v"))
                near = _near(x, c) if len(c) else np.zeros(0, int)
                yield b, near, (x - c[near]).round(9)

        def squares(batches):
            import pyarrow as pa

            for _, _, r in residuals(batches):
                yield pa.RecordBatch.from_arrays([pa.array([r.size]), pa.array([float((r * r).sum())])], names=["n", "s"])

        one = rows.select("v").mapInArrow(squares, "n long, s double").agg(F.sum("s") / F.sum("n")).first()[0]
        cut = CUT * float(np.sqrt(one or 0.0))

        def buckets(batches):
            import pyarrow as pa

            for _, _, r in residuals(batches):
                code = _bucket(r, cut)
                yield pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(np.bincount(code.ravel(), minlength=4)), pa.array(np.bincount(code.ravel(), r.ravel(), 4))], names=["k", "n", "s"])

        means = {r.k: r.m for r in rows.select("v").mapInArrow(buckets, "k long, n long, s double").groupBy("k").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m")).collect()}
        levels = [float(means.get(k) or 0.0) for k in range(4)]

        def coded(batches):
            import pyarrow as pa

            for b, near, r in residuals(batches):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pos"), pa.array(near.astype(np.int64)), pa.array([_pack(x) for x in _bucket(r, cut)], pa.binary())], names=["doc_id", "pos", "centroid", "code"])

        kind = lambda name: rows.schema[name].dataType.simpleString()
        slabs = _parts(n, dim, slab_bytes)
        codes = rows.mapInArrow(coded, f"doc_id {kind('doc_id')}, pos {kind('pos')}, centroid long, code binary").withColumn("slab", F.pmod(F.xxhash64("doc_id"), F.lit(slabs)).cast("int"))
        codes.repartitionByRange("slab", "centroid").sortWithinPartitions("slab", "centroid", "doc_id", "pos").write.parquet(f"{path}/codes")
        packed(rows, "doc_id").write.parquet(f"{path}/vectors")
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "c long, v array<double>").write.parquet(f"{path}/centroids")
        spark.createDataFrame([(dim, slabs, cut, levels, digits, n)], "dim int, slabs int, cut double, levels array<double>, digits int, n long").write.parquet(f"{path}/settings")
        return cls(spark, path)

    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def reconstructed(self) -> DataFrame:
        """(doc_id, pos, centroid, v) as the codes give them."""
        c, levels, dim = self.centroids, self.levels, self.dim

        def decode(batches):
            import pyarrow as pa

            for b in batches:
                near = np.asarray(b.column("centroid"), np.int64)
                x = c[near] + levels[_unpack(b.column("code"), dim)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pos"), b.column("centroid"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "pos", "centroid", "v"])

        rows = self.codes().select("doc_id", "pos", "centroid", "code")
        kind = lambda name: rows.schema[name].dataType.simpleString()
        return rows.mapInArrow(decode, f"doc_id {kind('doc_id')}, pos {kind('pos')}, centroid long, v array<double>")

    def search(self, queries: DataFrame, top_k: int = 5, n_probe: int = 4, candidates: int = 64, block_bytes: int = 1 << 20) -> DataFrame:
        """(qid, rank, doc_id, score, share): the best of the candidates by their exact score; share: the part of all vectors that a query decoded.

        A vector of a query looks into the lists of its n_probe nearest centroids (by inner product); passages met there get, for each vector of the query, the
        largest product with a decoded vector (0 where none was met). The first ``candidates`` of them are ranked with the exact vectors.
        """
        c, levels, dim, digits = self.centroids, self.levels, self.dim, self.digits
        asked = usable(queries, None, "qid")
        blocks = _parts(asked.count(), dim, block_bytes)
        asked = packed(asked.where(F.size("v") == dim), "qid")

        def probe(a, b):
            import pyarrow as pa

            q, begin = _flat(b.column("vs"))
            found: list[tuple] = []
            if a.num_rows and b.num_rows:
                ids, near = _ids(a.column("doc_id")), np.asarray(a.column("centroid"), np.int64)
                order = np.argsort(ids, kind="stable")
                ids, near = ids[order], near[order]
                names, at = np.unique(ids, return_index=True)
                x = c[near] + levels[_unpack(a.column("code"), dim)[order]]
                for i, qid in enumerate(b.column("qid").to_pylist()):
                    mine = q[begin[i] : begin[i + 1]]
                    lists = np.argsort(-(mine @ c.T), axis=1, kind="stable")[:, :n_probe]
                    wanted = np.zeros((len(mine), len(c)), bool)
                    np.put_along_axis(wanted, lists, True, axis=1)
                    rows = np.flatnonzero(wanted.any(0)[near])
                    found.append((qid, None, None, len(rows)))
                    if len(rows):
                        s = np.where(wanted[:, near[rows]], mine @ x[rows].T, -np.inf)
                        doc = np.searchsorted(at, rows, "right") - 1
                        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                        best = np.maximum.reduceat(s, first, axis=1)
                        total, own = np.where(np.isinf(best), 0, best).sum(0).round(digits), names[doc[first]]
                        found += [(qid, own[j].item(), total[j], None) for j in _first(total, own, candidates)]
            return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((b.column("qid").type, a.column("doc_id").type, pa.float64(), pa.int64()))], names=["qid", "doc_id", "score", "decoded"])

        codes, exact = self.codes().select("doc_id", "centroid", "code"), self.vectors()
        types = [df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (codes, "doc_id"))]
        met = stored(meet(codes, "doc_id", self.slabs, asked, blocks, probe, f"qid {types[0]}, doc_id {types[1]}, score double, decoded long"), "late-candidates")
        share = met.groupBy("qid").agg((F.sum("decoded") / F.lit(max(1, self.n))).alias("share"))
        best = ranked(met.where("decoded is null"), candidates).select("qid", "doc_id")

        def rerank(batches):
            import pyarrow as pa

            for b in batches:
                (x, at), (q, begin) = _flat(b.column("vs")), _flat(b.column("qvs"))
                scores = [float((q[begin[i] : begin[i + 1]] @ x[at[i] : at[i + 1]].T).max(1).sum().round(digits)) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("doc_id"), pa.array(scores, pa.float64())], names=["qid", "doc_id", "score"])

        pairs = best.join(exact, "doc_id").join(asked.withColumnRenamed("vs", "qvs"), "qid").select("qid", "doc_id", "vs", "qvs")
        hits = pairs.mapInArrow(rerank, f"qid {types[0]}, doc_id {types[1]}, score double")
        return ranked(hits, top_k).join(share, "qid").select("qid", "rank", "doc_id", "score", "share")


def _bucket(r: np.ndarray, cut: float) -> np.ndarray:
    return (r >= -cut).astype(np.uint8) + (r >= 0) + (r >= cut)


def _pack(code: np.ndarray) -> bytes:
    """Four codes a byte."""
    bits = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    bits[: len(code)] = code
    four = bits.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def _unpack(column, dim: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.stack([data >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(column), -1)[:, :dim]
