from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailforge.operators import evaluation, trajectories
from trailforge.sources import jsonl
from trailforge.streaming import transcripts


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_damaged_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "q": "x"}\n{"id": 2, "q": "cut\n\n{"id": "no number", "q": "y"}\nnot json\n{"id": 3}\n')
    (tmp_path / "b.json").write_text('{"id": 4, "q": "z", "more": 1}\n[1]\n')
    good, bad = jsonl.read_checked(spark, str(tmp_path), "id long, q string")
    assert rows_of(good.select("id", "q")) == [(1, "x"), (3, None), (4, "z")]
    assert [r.pos for r in good.orderBy("pos").collect()] == [0, 4, 5]
    assert rows_of(bad.select("pos", "file", "line")) == [(1, "a.json", '{"id": 2, "q": "cut'), (2, "a.json", '{"id": "no number", "q": "y"}'), (3, "a.json", "not json"), (6, "b.json", "[1]")]


def test_a_list_of_names_must_name_something(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert rows_of(jsonl.named(rows, "b, c")) == [("b",)]
    for names in ("", " , ", "c"):
        with pytest.raises(ValueError, match="no dataset"):
            jsonl.named(rows, names)


def test_partitions_replace_themselves_only(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "i int, dataset string, split string"
    jsonl.write_partitions(spark.createDataFrame([(i, f"d{i % 2}", "train" if i % 3 else "dev") for i in range(12)], schema).repartition(5), path, ["dataset", "split"])
    files = {str(p) for p in Path(path).rglob("*.json")}
    assert len(files) == 4  # one for each
    jsonl.write_partitions(spark.createDataFrame([(100, "d0", "dev"), (101, "d2", "dev")], schema), path, ["dataset", "split"])
    now = {str(p) for p in Path(path).rglob("*.json")}
    assert {f for f in files if "dataset=d0/split=dev" not in f} <= now and len(now) == 5
    back = spark.read.schema(schema).json(path)
    assert rows_of(back.where("split = 'dev'").select("i")) == [(100,), (101,), (3,), (9,)]
    assert back.where("split = 'train'").count() == 8
    jsonl.write_partitions(spark.range(400).selectExpr("cast(id as int) i", "'d0' dataset", "'dev' split"), path, ["dataset", "split"], files=3)
    assert len(list((tmp_path / "out/dataset=d0/split=dev").glob("*.json"))) in (1, 2, 3) and spark.read.schema(schema).json(path).where("dataset = 'd0' and split = 'dev'").count() == 400


def test_counts_come_from_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, False, "Answer: x"), ("a", 0, False, "Answer: x"), ("b", 1, True, ""), ("b", 1, None, "")], "dataset string, num_search_steps int, incomplete boolean, text string")
    seen = jsonl.write_counted(rows, str(tmp_path / "out"), {"total": F.count(F.lit(1)), "valid": F.count_if(trajectories.valid())}, ["dataset"])
    summary = trajectories.generation_summary(rows).collect()
    assert seen == {"total": 4, "valid": sum(r.valid for r in summary)} and seen["valid"] == 2
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_a_missing_prediction_counts(spark):
    gold = spark.createDataFrame([("1", "q", "red"), ("2", "q", "blue"), ("3", "q", "")], "id string, question string, answer string")
    found = spark.createDataFrame([("1", "Answer: red"), ("9", "Answer: x")], "id string, text string")
    rows = {r.id: (r.prediction, r.em, r.f1, r.missing) for r in evaluation.evaluate(found, gold).collect()}
    assert rows == {"1": ("red", 1.0, 1.0, False), "2": ("", 0.0, 0.0, True), "3": ("", 1.0, 1.0, True)}
    one = evaluation.summarize(evaluation.evaluate(found, gold).withColumn("name", F.lit("all"))).first()
    assert (one.n, one.missing, one.em) == (3, 2, pytest.approx(2 / 3))


def arrive(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "dataset": d, "text": t, "num_search_steps": n, "incomplete": False}) + "\n" for i, d, t, n in rows))


def test_a_batch_that_is_written_again_adds_nothing(spark, tmp_path):
    came, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    go = lambda: transcripts.append_once(transcripts.annotate(transcripts.read_stream(spark, str(came))), out, cp).awaitTermination()
    arrive(came, "a.json", ("1", "x", "Answer: a", 1), ("2", "x", "Answer: b", 0))
    go()
    arrive(came, "b.json", ("3", "y", "Answer: c", 2))
    go()
    go()
    schema = "id string, answer string, valid boolean, batch long"
    once = rows_of(spark.read.schema(schema).json(out))
    assert once == [("1", "a", True, 0), ("2", "b", False, 0), ("3", "c", True, 1)]
    again = transcripts.annotate(spark.read.schema(transcripts.TRAJECTORIES).json(str(came / "b.json")))
    transcripts.write_batch(again, 1, out)
    assert rows_of(spark.read.schema(schema).json(out)) == once


def test_the_streams_summary_is_that_of_all_files(spark, tmp_path):
    came, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(4):
        arrive(came, f"{i}.json", *((f"{i}-{j}", "xyz"[(i + j) % 3], "Answer: a" if j else "", j % 2) for j in range(5)))
        transcripts.summarize(transcripts.read_stream(spark, str(came), 1), out, str(tmp_path / "cp")).awaitTermination()
        whole = trajectories.generation_summary(spark.read.schema(transcripts.TRAJECTORIES).json(str(came)))
        assert rows_of(spark.read.parquet(out)) == rows_of(whole)


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    """One task for a whole dataset and split would read all of it."""
    name, path = "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(tmp_path / "qa")
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "sha2(string(id), 256) AS text", "if(id % 100 = 0, 'b', 'a') AS dataset")
    before = spark.conf.get(name)
    spark.conf.set(name, "50k")
    try:
        jsonl.write_partitions(rows, path, ["dataset"])
    finally:
        spark.conf.set(name, before)
    back = spark.read.schema("id long, text string, dataset string").json(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "qa" / "dataset=a").glob("part-*"))) > 1 and len(list((tmp_path / "qa" / "dataset=b").glob("part-*"))) == 1
