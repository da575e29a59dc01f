from __future__ import annotations

import numpy as np
import pytest

from trailforge.operators import late, retrieval

SCHEMA = "doc_id long, pos int, embedding array<double>"
Q = "qid string, pos int, embedding array<double>"


def brute(docs, queries, k):
    """The best passages by the sum of the largest products, from dicts of lists of vectors."""
    out = {}
    for qid, q in queries.items():
        scored = sorted((-round(sum(max(float(np.dot(a, b)) for b in d) for a in q), 5), i) for i, d in docs.items())
        out[qid] = [(i, -s) for s, i in scored[:k]]
    return out


def rows(docs):
    return [(i, p, list(map(float, v))) for i, d in docs.items() for p, v in enumerate(d)]


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.doc_id, r.score))
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    topics = rng.normal(size=(12, 16))
    docs = {i: [topics[(i + j) % 12] + 0.3 * rng.normal(size=16) for j in range(int(rng.integers(1, 9)))] for i in range(400)}
    longest = max(docs, key=lambda i: len(docs[i]))
    docs |= {1000 + i: docs[longest] for i in range(40)}  # copies: ties
    queries = {f"q{i}": [v + 0.1 * rng.normal(size=16) for v in docs[i]] for i in range(0, 400, 25)}
    return docs, queries


def test_late_search_is_exact(spark, made):
    docs, queries = made
    odd = [(2000, 0, None), (2001, 0, [float("nan")] * 16), (2002, 0, [1.0, None]), (2003, 0, [1.0]), (2004, 0, []), (2005, 0, [float("inf")] + [0.0] * 15)]
    df, asked = spark.createDataFrame(rows(docs) + odd, SCHEMA), spark.createDataFrame(rows(queries), Q)
    want = brute(docs, queries, 6)
    a, b = (i for i, _ in want["q0"][:2])
    passages = spark.createDataFrame([(a, "t", "x"), (b, None, None)], "doc_id long, title string, text string")
    hits = late.LateIndex(df, passages, slab_bytes=20_000, block_bytes=3_000).search(asked, 6).cache()
    got = found(hits)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-5) for q in want)
    assert {(r.doc_id, r.title, r.text) for r in hits.collect() if r.doc_id in (a, b)} == {(a, "t", "x"), (b, "", "")}


def test_late_search_with_longest_passages_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 9.0]), (2, 0, [2.0, 0.0])], SCHEMA)
    asked = spark.createDataFrame([("q", 0, [1.0, 1.0])], Q)
    assert found(late.LateIndex(df).search(asked)) == {"q": [(1, 9.0), (2, 2.0)]}
    assert found(late.LateIndex(df, most_vectors=1).search(asked)) == {"q": [(2, 2.0), (1, 1.0)]}
    assert late.LateIndex(df.limit(0)).search(asked).count() == 0
    assert late.LateIndex(df).search(asked.limit(0)).count() == 0


def test_codes_are_packed_without_loss():
    import pyarrow as pa

    code = np.random.default_rng(0).integers(0, 4, (50, 13)).astype(np.uint8)
    data = [late._pack(c) for c in code]
    assert {len(d) for d in data} == {4}
    assert (late._unpack(pa.array(data, pa.binary()), 13) == code).all()


def test_quantized_search_finds_most_with_few_vectors(spark, made, tmp_path):
    docs, queries = made
    df, asked = spark.createDataFrame(rows(docs), SCHEMA), spark.createDataFrame(rows(queries), Q)
    built = late.ResidualIndex.build(df, str(tmp_path / "index"), centroids=64, steps=4, slab_bytes=2_000)
    assert built.slabs > 2
    index = late.ResidualIndex.open(spark, str(tmp_path / "index"))
    hits = index.search(asked, 5, n_probe=6, candidates=40, block_bytes=3_000).cache()
    got, want = found(hits), brute(docs, queries, 5)
    least = {q: h[-1][1] for q, h in want.items()}
    assert np.mean([sum(s >= least[q] - 1e-5 for _, s in got.get(q, [])) / 5 for q in want]) >= 0.9  # copies tie
    share = {r.qid: r.share for r in hits.collect()}
    assert np.mean(list(share.values())) < 0.45 and all(s > 0 for s in share.values())
    # all lists and all candidates: the exact result
    assert {q: [i for i, _ in h] for q, h in found(index.search(asked, 5, n_probe=64, candidates=10_000)).items()} == {q: [i for i, _ in h] for q, h in want.items()}
    near = {(r.doc_id, r.pos): np.array(r.v) for r in index.reconstructed().collect()}
    x = {(i, p): np.array(v) for i, p, v in rows(docs)}
    assert set(near) == set(x)
    error = np.mean([((near[k] - x[k]) ** 2).mean() for k in x])
    alone = np.mean([min(((v - c) ** 2).mean() for c in index.centroids) for v in x.values()])
    assert error < 0.3 * alone  # two bits leave 0.12 of the variance of normal residuals


def test_factory_gives_late_interaction(spark):
    assert isinstance(retrieval.create_search_engine("colbert", vectors=spark.createDataFrame([], SCHEMA)), late.LateIndex)


def test_quantized_index_of_few_and_of_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 1.0])], SCHEMA)
    asked = spark.createDataFrame([("q", 0, [1.0, 0.5])], Q)
    assert found(late.ResidualIndex.build(df, str(tmp_path / "a")).search(asked, 2)) == {"q": [(1, 1.0), (2, 1.0)]}
    assert late.ResidualIndex.build(df.limit(0), str(tmp_path / "b")).search(asked).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        late.ResidualIndex.build(df, str(tmp_path / "c"), centroids=1 << 23)


def test_dense_search_in_blocks_is_that_of_a_broadcast(spark, made, monkeypatch):
    vectors = spark.createDataFrame([(i, list(map(float, d[0]))) for i, d in made[0].items()], "doc_id long, embedding array<double>")
    queries = vectors.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "qid")
    whole = found(retrieval.DenseIndex(vectors).search(queries, 4))
    monkeypatch.setattr(retrieval, "MOST_BROADCAST_BYTES", 1000)
    assert found(retrieval.DenseIndex(vectors).search(queries, 4)) == whole and len(whole) == 44


def test_dense_vectors_that_take_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0]), (7, [-2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    hits = retrieval.DenseIndex(vectors).search(vectors.where("doc_id < 4").withColumnRenamed("doc_id", "qid"), 3)
    assert found(hits) == {1: [(1, 1.0), (6, 0.70711), (7, -1.0)]}


def test_slabs_are_bounded_by_their_decoded_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, [float(i % 7), 1.0, float(i % 3), 2.0]) for i in range(64)], SCHEMA)
    built = late.ResidualIndex.build(df, str(tmp_path / "index"), centroids=4, steps=1, slab_bytes=256)
    assert built.slabs == 64 * 4 * 8 // 256
    assert max(r["count"] for r in built.codes().groupBy("slab").count().collect()) < 32
