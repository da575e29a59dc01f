from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from trailforge.llm.common import Scratch
from trailforge.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 0))
    passage = " ".join(f"p{x}" for x in rng.integers(0, 999, 70))
    rows += [(200, rows[0][1], "en", "src0", 0), (201, rows[1][1] + " tail", None, None, 0), (202, "short", "en", "src1", 0), (203, None, "en", "src1", 0)]
    rows += [(210 + k, f"{rows[k + 5][1][::-1]} {passage} {k}", "de", "src2", 0) for k in range(3)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, passage


def test_stages(spark, tables):
    folder, rows, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        found = kept.collect()
        kept = spark.createDataFrame(found, docs.schema)
        seen.append({r.doc_id: r.text for r in found})
    assert set(seen[0]) == {r[0] for r in rows} - {202, 203}  # too short
    assert set(seen[1]) == set(seen[0]) - {200, 201}  # copies
    assert all(passage in seen[1][i] and passage not in seen[2][i] for i in (210, 211, 212))
    assert all(seen[2][i] == seen[1][i] for i in range(120))
    assert seen[3] == seen[2]


def test_stages_carry_columns_of_any_name(spark, tables, tmp_path):
    folder, rows, _ = tables
    names = ["__nth", "a.b", "_metadata", "__row", "__key", "`x`", "slab", "rules", "__slot", "kept"]
    docs = spark.createDataFrame([(*r, *(f"{n} {r[0]}" for n in names)) for r in rows if r[0] < 40 or r[0] >= 200], ["doc_id", "text", "lang", "source", "n_chars", *names])
    stages = corpus_pipeline.STAGES
    for i, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, folder)
        if i + 1 < len(stages):
            assert docs.columns[5:] == names, name
            docs.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            assert all(list(r[5:]) == [f"{n} {r.doc_id}" for n in names] for r in docs.collect()), name
    assert {r.doc_id for r in docs.collect()} == {*range(40), 210, 211, 212}


def test_run_packs_what_is_left(spark, tables):
    out = corpus_pipeline.run(spark, tables[0]).collect()
    assert {r.doc_id for r in out} == {r[0] for r in tables[1]} - {200, 201, 202, 203}
    assert all(r.offset + r.length <= 4096 for r in out)


def test_lazy_results_survive_a_pipeline(spark, tables):
    lazy = QUERIES["op10_packing"](spark, tables[0])
    corpus_pipeline.run(spark, tables[0]).count()
    assert {r.doc_id for r in lazy.collect()} == {r[0] for r in tables[1]}
    with Scratch() as own:
        found = QUERIES["op10_packing"](spark, tables[0])
        assert found.count() and own.paths
    own.release(spark)
    assert not own.paths


def test_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_sequences_follow_the_mix(spark, tmp_path):
    """Two blocks of source a and one of b, each document more than a window: a, b, a; the last files are the largest."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 2500 if 64 <= i < 128 else 1500)), "en", "a" if i < 128 else "b", 0) for i in range(192)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id for r in out} == set(range(192))
    full = sorted((r.sequence_id, r.start, r.doc_id) for r in out if r.length == 4096)
    assert [i for _, start, i in full if start == 0] == [*range(64), *range(128, 192), *range(64, 128)]


def test_registered():
    assert {f"op{n}_" for n in range(1, 13)} == {k.split("_")[0] + "_" for k in QUERIES if k.startswith("op")}
    assert "pipeline" in QUERIES and set(SQL) <= set(QUERIES)
