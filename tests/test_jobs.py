from __future__ import annotations

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import corpus, registered, settings, transcripts
from trailforge.operators import ordering

ROOT = Path(__file__).resolve().parent.parent
SMALL = corpus.Settings(separator="|", most_rows_a_file=3)
DOCS = "doc_id long, source string, text string, lang string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(folder: Path) -> dict[str, int]:
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(1, "b", "x|y||x", "en"), (0, "b", "z|y", "en"), (2, "c", None, "en"), (3, "c", "", "de"), (4, None, "n|n", "de"), (5, "a", "q", "de"), (6, "a", "q|r.s|" + "|".join(str(i) for i in range(20)), "de")]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return path


def test_corpus_job(spark, docs, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    out = rows_of(corpus.run(spark, docs, str(tmp_path / "out"), SMALL).select("id", "title", "text", "nth"))
    want = [("b_0", "b", "z", 0), ("b_1", "b", "y", 1), ("b_2", "b", "x", 2), ("a_0", "a", "q", 0), ("a_1", "a", "r.s", 1), ("0", None, "n", 0)] + [(f"a_{i + 2}", "a", str(i), i + 2) for i in range(20)]
    assert out == sorted(want, key=str)
    assert "'rows': 7, 'without_text': 1" in caplog.text and "'rows': 32, 'empty': 2" in caplog.text and "wrote 26 rows" in caplog.text and "wrote 3 rows" in caplog.text
    assert rows_of(corpus.run(spark, docs, str(tmp_path / "out"), SMALL).select("id", "title", "text", "nth")) == out
    counts = {r.title: (r.passages, r.chars) for r in spark.read.parquet(str(tmp_path / "out/titles")).collect()}
    assert counts["b"] == (3, 3) and counts["a"][0] == 22
    most = spark.read.parquet(str(tmp_path / "out/passages")).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most <= 3


def test_corpus_files_are_in_title_order(spark, docs, tmp_path):
    corpus.run(spark, docs, str(tmp_path / "out"), SMALL)
    for shard in (tmp_path / "out/passages").glob("shard=*"):
        found = [(r.title, r.nth) for p in sorted(shard.glob("*.parquet")) for r in spark.read.parquet(str(p)).collect()]
        assert found == sorted(found, key=lambda x: (x[0] is not None, x))


def test_corpus_job_replaces_only_the_shards_asked(spark, docs, tmp_path):
    out = tmp_path / "out"
    first = rows_of(corpus.run(spark, docs, str(out), SMALL))
    before = files(out / "passages")
    shard_of = {r.title: r.shard for r in spark.read.schema(corpus.PASSAGES).parquet(str(out / "passages")).collect()}
    more = spark.createDataFrame([(7, "a", "new", "en"), (8, "b", "new", "en")], DOCS)
    more.write.mode("append").parquet(docs)
    again = rows_of(corpus.run(spark, docs, str(out), SMALL, shards=[shard_of["b"]]))
    assert [r for r in again if r not in first] == [("b_3", "b", "new", 3, shard_of["b"])]
    after = files(out / "passages")
    assert shard_of["a"] != shard_of["b"]
    assert {k: v for k, v in before.items() if f"shard={shard_of['b']}/" not in k} == {k: v for k, v in after.items() if f"shard={shard_of['b']}/" not in k}
    titles = {r.title: r.passages for r in spark.read.parquet(str(out / "titles")).collect()}
    assert titles["b"] == 4 and titles["a"] == 22
    # a full run leaves no partition of titles that are gone
    spark.createDataFrame([("b",)], "title string").write.parquet(str(tmp_path / "titles"))
    last = corpus.run(spark, docs, str(out), SMALL, titles=str(tmp_path / "titles"))
    assert {r.title for r in last.collect()} == {"b"} and {p.parts[-2] for p in (out / "passages").rglob("*.parquet")} == {f"shard={shard_of['b']}"}


def test_corpus_numbers_by_ranges_where_a_title_is_large(spark, docs, tmp_path, monkeypatch):
    whole = rows_of(corpus.run(spark, docs, str(tmp_path / "a"), SMALL))
    monkeypatch.setattr(ordering, "MOST_IN_TASK", 3)
    assert rows_of(corpus.run(spark, docs, str(tmp_path / "b"), SMALL)) == whole


def test_corpus_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert corpus.run(spark, str(tmp_path / "none"), str(tmp_path / "out"), SMALL).count() == 0




def conversation(i, turns):
    return [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {i} with some words") for t in turns]


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, transcripts.TURNS).coalesce(1).write.mode("append").parquet(str(folder))


def test_transcripts_job_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    config, came, out, cp = transcripts.Settings(conversations_a_part=2), tmp_path / "in", tmp_path / "out", str(tmp_path / "cp")
    go = lambda: transcripts.run(spark, str(came), str(out), cp, config)
    first = conversation(0, [0, 1]) + conversation(1, [0, 1, 2, 3]) + conversation(2, [0]) + [(None, 0, "user", "lost"), (5, None, "user", "lost")]
    arrive(spark, came, first)
    a = rows_of(go())
    assert [r[0] for r in a] == ["c0_0_traj", "c1_0_traj", "c2_0_traj"]
    before = files(out / "transcripts")
    assert rows_of(go()) == a and files(out / "transcripts") == before  # nothing new
    second = conversation(2, [1, 2]) + conversation(9, [0, 1])
    arrive(spark, came, second)
    b = rows_of(go())
    whole = transcripts.transcripts_of(spark.createDataFrame(first + second, transcripts.TURNS).where("conv_id is not null and turn is not null").withColumn("batch", F.lit(0)), config)
    assert b == rows_of(whole)
    after = files(out / "transcripts")
    assert {k: v for k, v in after.items() if "part=0/" in k} == {k: v for k, v in before.items() if "part=0/" in k}  # its conversations got nothing new
    batches = {r.batch: r for r in spark.read.parquet(str(out / "batches")).collect()}
    assert [(batches[i].turns, batches[i].left_out, batches[i].parts) for i in (0, 1)] == [(7, 2, 2), (4, 0, 2)]
    assert "took 0 new rows" in caplog.text and "took 9 new rows" in caplog.text and "took 4 new rows" in caplog.text


def test_a_batch_that_is_run_again_and_rows_that_come_twice_add_nothing(spark, tmp_path):
    config, came, out = transcripts.Settings(conversations_a_part=2), tmp_path / "in", str(tmp_path / "out")
    first, second = conversation(0, [0, 1]), conversation(0, [1, 2]) + conversation(3, [0])
    arrive(spark, came, first)
    transcripts.run(spark, str(came), out, str(tmp_path / "cp"), config)
    arrive(spark, came, second)
    once = rows_of(transcripts.run(spark, str(came), out, str(tmp_path / "cp"), config))
    transcripts.take(spark.createDataFrame(second, transcripts.TURNS), 1, out, config)
    assert rows_of(spark.read.schema(transcripts.TRANSCRIPTS).parquet(f"{out}/transcripts")) == once
    assert spark.read.schema(transcripts.STORED).parquet(f"{out}/turns").count() == 5
    assert spark.read.schema(transcripts.BATCHES).parquet(f"{out}/batches").count() == 2
    # a later correction of a turn counts
    arrive(spark, came, [(0, 2, "user", "said otherwise")])
    texts = {r.id: r.text for r in transcripts.run(spark, str(came), out, str(tmp_path / "cp"), config).collect()}
    assert "said otherwise" in texts["c0_0_traj"] and "turn 2 of 0" not in texts["c0_0_traj"]


def test_transcripts_of_small_batches_and_of_nothing(spark, tmp_path):
    came = tmp_path / "in"
    for i in range(3):
        arrive(spark, came, conversation(i, [0, 1]) + conversation(7, [i]))
    a = transcripts.run(spark, str(came), str(tmp_path / "a"), str(tmp_path / "cpa"), transcripts.Settings())
    b = transcripts.run(spark, str(came), str(tmp_path / "b"), str(tmp_path / "cpb"), transcripts.Settings(files_a_batch=1))
    assert rows_of(a) == rows_of(b) and a.count() == 4
    assert spark.read.parquet(str(tmp_path / "b/batches")).count() == 3
    spark.createDataFrame([], transcripts.TURNS).write.parquet(str(tmp_path / "none"))
    assert transcripts.run(spark, str(tmp_path / "none"), str(tmp_path / "c"), str(tmp_path / "cpc"), transcripts.Settings()).count() == 0


def test_settings(tmp_path):
    assert settings.load(corpus.Settings, str(ROOT / "jobs/corpus.json")) == corpus.Settings()
    assert settings.load(transcripts.Settings, str(ROOT / "jobs/transcripts.json")) == transcripts.Settings()
    (tmp_path / "x.json").write_text(json.dumps({"shards": 3}))
    with pytest.raises(ValueError, match="shards"):
        settings.load(corpus.Settings, str(tmp_path / "x.json"))


def test_registered_jobs_leave_settings_alone(spark):
    before = dict(spark.conf.getAll)
    for query in registered.QUERIES.values():
        assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("job", ["corpus", "transcripts"])
def test_command_lines(job, docs, tmp_path):
    how = ["--documents", docs] if job == "corpus" else ["--conversations", "/root/testdata/sf0.001/conversations.parquet", "--checkpoint", str(tmp_path / "cp")]
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), *how, "--output", str(tmp_path / "out")], capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job}" in done.stderr and any((tmp_path / "out").rglob("*.parquet"))
