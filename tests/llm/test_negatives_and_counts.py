from __future__ import annotations

import numpy as np
import pytest

from trailforge.llm import hardneg, queries, resync
from trailforge.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
MODEL = public_path("piece_bpe_32k.model")


def brute_negatives(rows, anchors, positives=5, negatives=10, window=(30, 90)):
    out = set()
    for a in anchors:
        label, q = rows[a]
        scored = sorted((-sum(x * y for x, y in zip(v, q, strict=True)), i, other) for i, (other, v) in rows.items() if i != a)
        for p, pid, _ in [r for r in scored if r[2] == label][:positives]:
            found = [(s, i) for s, i, other in scored if other != label and window[0] * -p <= 100 * -s <= window[1] * -p]
            out |= {(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(found[:negatives], 1)}
    return out


def mined(index, anchors, **how):
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in index.mine(anchors, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("spread", [2, 60])
def test_negatives_equal_a_full_scan_with_ties_copies_and_odd_rows(spark, spread):
    rng = np.random.default_rng(spread)
    rows = {i: (int(rng.integers(4)), rng.integers(-spread, spread + 1, 7).tolist()) for i in range(900)}
    rows |= {1000 + i: (i % 3, rows[5][1]) for i in range(300)}  # one vector that a fourth of all rows share
    rows |= {2000: (9, [1] * 7), 2001: (0, [0] * 7)}  # a label with one row; a zero vector
    odd = [(3000, None, [1] * 7), (3001, 1, None), (3002, 1, [1, None, 1, 1, 1, 1, 1]), (None, 1, [1] * 7), (3003, 1, [1, 2]), (3004, 1, []), (7, *rows[7])]
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()] + odd, "vec_id long, label int, vector array<long>").selectExpr("*", "1 as block", "'x' as slab", "0 as `a.b`")
    index = hardneg.PqIndex(df, sample=200, slab_bytes=16_000, block=10)
    assert index.slabs > 3
    asked = [*range(0, 900, 40), 1001, 2000, 2001]
    anchors = df.where(df.vec_id.isin([*asked, 3000, 3003, 99999]))
    assert mined(index, anchors) == brute_negatives(rows, asked)
    assert mined(index, anchors, positives=2, negatives=3, window=(0, 100)) == brute_negatives(rows, asked, 2, 3, (0, 100))


def test_bounds_hold_and_leave_few_candidates():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4000, 32)) / 6).astype(np.int64)
    books = hardneg.codebooks(x[:2000], 2)
    codes, rest = hardneg.encode(x, books, 2)
    slab = hardneg.Slab(pa.table({"vec_id": np.arange(4000), "label": np.zeros(4000, np.int64), "vector": pa.array(list(x)), "codes": [c.tobytes() for c in codes], "rest": rest}), books, 2, 32)
    for q in x[:50]:
        low, up = slab.bounds(q, [slice(0, 4000)])
        s = slab.x @ q
        assert (low <= s).all() and (s <= up).all()
        assert (up >= np.sort(low)[-5]).mean() < 0.1


def test_negatives_of_empty_tables_and_too_large_numbers(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = hardneg.prepared(spark.createDataFrame([], schema))
    assert hardneg.PqIndex(none).mine(none).count() == 0
    one = hardneg.prepared(spark.createDataFrame([(100, [1.0], 1), (200, [float("nan")], 1), (300, [float("inf")], 1), (400, [1.0], None)], schema))
    assert [(r.vec_id, r.label, r.vector) for r in one.collect()] == [(100, 1, [256])]
    assert hardneg.PqIndex(one).mine(one).count() == 0
    with pytest.raises(ValueError, match="long"):
        hardneg.PqIndex(spark.createDataFrame([(1, [1 << 40], 1)], "vec_id long, vector array<long>, label int"))


def test_registered_negatives_equal_a_full_scan(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding):
            rows[r.vec_id] = ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding])
    got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in queries.QUERIES["op11_hard_negatives"](spark, SF).collect()}
    assert got == brute_negatives(rows, [i for i in rows if i % 100 == 0])


def odd_texts(rng):
    alphabet = list("ab é\n\t\0 ▁漢字𝄞🙂́‍") + ["</s>", "<unk>", "<0x0A>", "  ", "    ", "the ", " and"]
    made = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 400, 120)]
    huge = ["a" * 3000, " " * 3000, "▁" * 999, "ab" * 1500, "漢字" * 700, "🙂" * 900, "x" * 1200 + " " + "x" * 1200, "\n" * 1000, "word " * 700, "in the" * 500, "</s>" * 600]
    return [*made, *huge, "", None, "a", " ", "a" * 64, "a" * 65]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (64, 2), (200, 200)])
def test_spliced_counts_are_those_of_whole_texts(spark, chunk, overlap):
    texts = odd_texts(np.random.default_rng(chunk + overlap))
    rows = [*enumerate(texts), (0, texts[0]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as part", "3 as n_tokens", "4 as `a.b`")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in resync.count_tokens(df, MODEL, chunk, overlap, 500).collect())
    model = resync.Pieces.of(MODEL)
    n = [len(model.sp.encode(t or "")) for _, t in rows]
    assert got == sorted((i is None, i or 0, len((t or "").encode()), k, k > 500) for (i, t), k in zip(rows, n, strict=True))


def test_overlaps_widen_only_where_no_cut_is_proven(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "plain words " * 500), (3, "short")], "doc_id long, text string")
    rounds = {r.doc_id: r.rounds for r in resync.count_tokens(df, MODEL, 64, 8).collect()}
    assert rounds[3] == 0 and rounds[2] == 1 and rounds[1] == 4  # chunks of 64, 512, 4096 characters, then the whole text
    assert resync.count_tokens(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        resync.count_tokens(df, MODEL, 64, 1)


def test_registered_counts_equal_the_library(spark):
    model = resync.Pieces.of(MODEL)
    want = {r.doc_id: (len((r.text or "").encode()), len(model.sp.encode(r.text or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op12_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
