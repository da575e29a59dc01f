from __future__ import annotations

import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.llm import ann, warc
from trailforge.llm.common import scratch

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        q = np.array(q, np.float32).astype(float)
        scored = []
        for vid, v in rows:
            if vid != qid:
                v = np.array(v, np.float32).astype(float)
                scored.append((-round(float(v @ q / np.sqrt(v @ v) / np.sqrt(q @ q)), 9), vid))
        out[qid] = sorted(set(scored))[:k]
    return out


def test_nearest_is_exact_where_all_leaves_are_visited(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, (np.array(rows[1][1]) * 2).tolist())]
    odd = [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [0.0] * 7), (3004, [1.0, None] + [0.0] * 6), (None, rows[0][1]), (3005, [1.0, 2.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    queries = spark.createDataFrame([rows[0], rows[1], rows[7], (3001, [0.0] * 8)], SCHEMA)
    got = ann.nearest(df, queries, 5).collect()
    want = brute(rows, [rows[0], rows[1], rows[7]], 5)
    for q, found in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [i for _, i in found]
        assert [r.score for r in mine] == pytest.approx([-s for s, _ in found])
    assert {r.query_id for r in got} == set(want)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 1")).collect()] == [(1, 2, 0.0)]
    assert ann.nearest(df.limit(0), df).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + rng.normal(size=32)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), 5, slab_rows=3000, query_block=25).collect()
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 5)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in found}) for q, found in want.items())
    assert hits >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("clustered", [False, True])
def test_a_slab_looks_at_a_part_of_its_vectors(clustered):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8000, 32))
    if clustered:
        x = rng.normal(size=(80, 32))[np.arange(8000) % 80] + 0.2 * x
    slab = ann.Slab(x, 64, 32, 0.008, 128)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = seen = 0
    for i in range(0, 8000, 100):
        found, _ = slab.best(x[i], 6, np.arange(8000))
        hits += len(set(found.tolist()) & set(np.argsort(-(unit @ unit[i]))[:6].tolist()))
        seen += len(slab.candidates(x[i]))
    assert hits >= 0.9 * 6 * 80 and seen < 0.45 * 8000 * 80
    assert len(slab.directions) < 0.1 * 8000  # what a query is projected on


def test_a_small_slab_is_searched_by_its_forest():
    rng = np.random.default_rng(2)
    slab = ann.Slab(rng.normal(size=(400, 16)), 8, 32, 0.05, 4)
    assert slab.depth == 4 and all(len(slab.candidates(q)) < 300 for q in slab.x[:20])
    assert all(sorted(o.tolist()) == list(range(400)) for o in slab.order)
    assert len(ann.Slab(slab.x[:32], 8, 32, 0.05, 1).candidates(slab.x[0])) == 32


def test_ties_go_to_the_smaller_identifier(spark):
    """More vectors of one direction than are kept, spread over slabs."""
    rows = [(100 - i, [float(2**i), 0.0]) for i in range(40)] + [(500 + i, [1.0, float(i + 1)]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(df, df.where("vec_id = 100"), 5, slab_rows=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [61, 62, 63, 64, 65] and all(r.score == 1.0 for r in got)
    clash = df.selectExpr("*", "1 AS slab", "2 AS block", "3 AS vkey", "4 AS ids", "5 AS first")
    assert [r.vec_id for r in ann.nearest(clash, clash.where("vec_id = 100")).orderBy("rank").collect()] == [61, 62, 63, 64, 65]


PAGES = [(1, "http://a/é b", "x" * 1500), (2, None, "x" * 1500), (3, "u\r\nEvil: y", "x" * 1500), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", "é" * 700), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90), (9, "u", "é" * 700), (9, "u", "é" * 700)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(PAGES)], "page_id long, url string, html string, digest int").repartition(3)
    plan = warc.plan_revisits(df)
    files = warc.files_written(warc.write_warc(plan, scratch(spark, "warc"), max_bytes=600))
    assert files.count() > 3
    rows = warc.read_warc(files).collect()
    assert len(rows) == len(PAGES)
    for page in {p[0] for p in PAGES}:
        html = next(p[2] for p in PAGES if p[0] == page) or ""
        mine = [r for r in rows if r.page_id == page]
        data = html.encode()
        assert all((r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest()) for r in mine)
        again = {1: 3, 2: 3, None: 9}.get(page)
        assert all((r.record_type, r.refers_to) == (("revisit", again) if again else ("response", None)) for r in mine)
        assert all(again or bytes(r.payload) == data for r in mine)
    assert warc.read_warc(warc.files_written(warc.write_warc(plan.limit(0), scratch(spark, "warc")))).count() == 0


def test_a_file_with_other_records_than_were_written_is_refused(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    files = warc.files_written(warc.write_warc(warc.plan_revisits(df).coalesce(1), scratch(spark, "warc")))
    assert warc.read_warc(files).count() == 5 == warc.read_warc(files.select("path")).count()
    for n in (4, 6):
        with pytest.raises(Exception, match="records, not"):
            warc.read_warc(files.withColumn("records", F.lit(n).cast("long"))).collect()


def test_reader_takes_members_one_by_one():
    data = [warc.record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, False) for i in range(5)]
    packed = b"".join(map(warc.member, data))
    assert gzip.decompress(packed) == b"".join(data)
    for chunk in (1, 7, 1 << 16):
        assert list(warc.members(io.BytesIO(packed), chunk)) == data
    last = len(packed) - len(warc.member(data[-1]))
    assert list(warc.members(io.BytesIO(packed[:last]))) == data[:-1]
    for cut in range(last + 1, len(packed)):  # at any byte of the last member but its end
        with pytest.raises(warc.WarcError):
            list(warc.members(io.BytesIO(packed[:cut])))
    with pytest.raises(warc.WarcError):
        warc.parse(data[3].replace(b"ppp", b"ppq"))
    with pytest.raises(warc.WarcError):
        warc.parse(data[3][:-1])
