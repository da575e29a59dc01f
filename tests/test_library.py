from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trailforge.operators import corpus, diagnostics, retrieval, trajectories
from trailforge.plans import prompts
from trailforge.sources import jsonl, schemas
from trailforge.streaming import transcripts


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame([(0, "p0", "A", "red car"), (1, "p1", "B", "red red bus"), (2, "p2", "C", "blue sky"), (3, None, None, "green")], "pos long, id string, title string, text string")


def test_bm25(spark, passages, tmp_path):
    queries = spark.createDataFrame([("q", "red bus"), ("none", "zebra")], "qid string, query string")
    index = retrieval.Bm25Index(passages)
    rows = index.search(queries, 3).orderBy("qid", "rank").collect()
    by = {q: [r.doc_id for r in rows if r.qid == q] for q in ("q", "none")}
    assert by["q"][0] == "p1"
    assert by["none"] == ["p0", "p1", "p2"]  # nothing matches: the first positions, with score 0
    assert index.search(queries, 3, pad=False).where("qid = 'none'").count() == 0
    index.save(str(tmp_path / "index"))
    again = retrieval.Bm25Index.load(spark, str(tmp_path / "index")).search(queries, 3).orderBy("qid", "rank").collect()
    assert again == rows
    assert isinstance(retrieval.create_search_engine("bm25", passages=passages), retrieval.Bm25Index)
    with pytest.raises(ValueError):
        retrieval.create_search_engine("other")


def test_injection(spark, passages):
    texts = spark.createDataFrame([("t", "go <search> red bus </search> on <search>sky</search>!"), ("u", "nothing")], "id string, text string")
    rows = {r.id: r for r in trajectories.inject_search_results(texts, retrieval.Bm25Index(passages), 1).collect()}
    assert rows["t"].text == "go <search>red bus</search>\n<results>\n[1] [B] red red bus\n</results> on <search>sky</search>\n<results>\n[1] [C] blue sky\n</results>!"
    assert [(r.query, r.num_results, r.doc_ids) for r in rows["t"].search_records] == [("red bus", 1, ["p1"]), ("sky", 1, ["p2"])]
    assert rows["u"].text == "nothing" and rows["u"].search_records == []


def test_assembly(spark):
    steps = [("a", 0, "x", "q", "search"), ("a", 1, "y", "  ", "search"), ("a", 2, "z", "r", "search"), ("b", 0, "x", None, "max_tokens"), ("c", 0, "1", "q", "search"), ("c", 1, "2", "q", "search"), ("c", 2, "3", "q", "search")]
    rows = {r.traj_id: r for r in trajectories.assemble(spark.createDataFrame(steps, "traj_id string, step int, text string, query string, stop_reason string"), 2).collect()}
    assert (rows["a"].text, rows["a"].num_search_steps, rows["a"].incomplete) == ("x<search>q</search>y", 1, False)
    assert (rows["b"].text, rows["b"].num_search_steps, rows["b"].incomplete) == ("x", 0, True)
    assert (rows["c"].num_search_steps, rows["c"].incomplete) == (2, False)


def test_attempts(spark):
    tries = [("q", 0, 0, 0), ("q", 0, 1, 2), ("q", 0, 2, 1), ("r", 0, 0, 0), ("r", 0, 1, 0)]
    rows = {r.question_id: r for r in trajectories.pick_attempts(spark.createDataFrame(tries, "question_id string, trajectory_idx int, attempt int, num_search_steps int")).collect()}
    assert (rows["q"].retry_count, rows["q"].no_search_after_retries) == (1, False)
    assert (rows["r"].retry_count, rows["r"].no_search_after_retries) == (1, True)


def test_corpus(spark):
    rows = [("B", "x", 1), ("A", "y", 2), ("A", "", 3), ("A", "z", 0), ("A", "y", 4)]
    df = spark.createDataFrame(rows, "title string, text string, pos int")
    assert [(r.id, r.text) for r in corpus.in_title_order(corpus.build_corpus(df)).collect()] == [("A_0", "z"), ("A_1", "y"), ("B_0", "x")]
    only = corpus.build_corpus(df, spark.createDataFrame([("B",)], "title string"))
    assert [r.id for r in only.collect()] == ["B_0"]


def test_datasets(spark, tmp_path):
    hot = {"id": "1", "question": "q", "answer": "a", "supporting_facts": {"title": ["x", "y", "z"], "sent_id": [0, 1]}, "context": {"title": ["T"], "sentences": [["s1", "s2"]]}}
    two = [{"_id": "2", "question": "q", "answer": "a", "supporting_facts": json.dumps([["t", 3], ["short"]])}, {"id": "3", "question": "q", "answer": "a", "supporting_facts": json.dumps({"title": ["t"], "sent_id": [1, 2]})}]
    (tmp_path / "hot_train.jsonl").write_text(json.dumps(hot) + "\n")
    (tmp_path / "two_train.jsonl").write_text("".join(json.dumps(x) + "\n" for x in two))
    a = jsonl.convert_dataset(spark, "hotpotqa", {"train": f"{tmp_path}/hot_train.jsonl", "validation": f"{tmp_path}/none.jsonl"}).collect()
    assert [(f.title, f.sent_id) for f in a[0].supporting_facts] == [("x", 0), ("y", 1)] and (a[0].dataset, a[0].split) == ("hotpotqa", "train")
    b = jsonl.convert_dataset(spark, "2wikimultihopqa", {"train": f"{tmp_path}/two_train.jsonl"}).orderBy("id").collect()
    assert [(r.id, [(f.title, f.sent_id) for f in r.supporting_facts]) for r in b] == [("2", [("t", 3)]), ("3", [("t", 1)])]
    raw = jsonl.read_jsonl(spark, f"{tmp_path}/hot_train.jsonl", schemas.HOTPOTQA)
    assert [(r.title, r.text) for r in corpus.context_passages(raw).collect()] == [("T", "s1 s2")]
    assert jsonl.load_questions(spark, f"{tmp_path}/two_train.jsonl", 0).count() == 1
    assert jsonl.read_glob(spark, str(tmp_path), "id string").count() == 3
    with pytest.raises(FileNotFoundError):
        jsonl.read_glob(spark, str(tmp_path), "id string", "*_none.jsonl")
    assert jsonl.read_if_there(spark, f"{tmp_path}/none.jsonl", "id string").count() == 0
    assert {r.dataset: r.status for r in jsonl.availability(spark, {"a": f"{tmp_path}/hot_train.jsonl", "b": f"{tmp_path}/no"}).collect()} == {"a": "ok", "b": "skipped"}
    with pytest.raises(ValueError):
        jsonl.named(raw, " , ")


def test_sinks(spark, passages, tmp_path):
    jsonl.write_tsv(jsonl.collection_rows(passages).coalesce(1), str(tmp_path / "tsv"))
    text = next((tmp_path / "tsv").glob("part-*")).read_text()
    assert text.splitlines()[0] == "0\tA red car"
    report = jsonl.write_report(spark.createDataFrame([("x", 1)], "name string, n int"), str(tmp_path / "r.json"), "name")
    assert json.loads((tmp_path / "r.json").read_text()) == report == {"x": {"n": 1}}
    jsonl.write_jsonl(passages, str(tmp_path / "out"), ["title"])
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("<search>a</search>\nAnswer: b", "no")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": str(i), "text": text, "num_search_steps": 1 - i, "incomplete": False}) + "\n")
        transcripts.append(transcripts.annotate(transcripts.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.answer, r.valid) for r in rows] == [("0", "b", True), ("1", "no", False)]


def test_prompts(spark):
    chat = spark.range(1).select(prompts.search_prompt(F.lit("100% {x}?")).alias("m")).first().m
    assert len(chat) == 6 and chat[-1].content.endswith("Question: 100% {x}?")
    assert len(spark.range(1).select(prompts.search_prompt(F.lit("q"), few_shot=False).alias("m")).first().m) == 2


def test_diagnostics(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 2.0, 3.0), ("h", 1.0, 1.0), ("h", 1.0, 2.0)], "g string, x double, y double")
    rho = {r.g: r.rho for r in diagnostics.spearman(df, ["g"], "x", "y").collect()}
    assert rho["g"] == pytest.approx(0.8660254) and rho["h"] is None
    std = {r.g: r["std"] for r in diagnostics.mean_std(df.where("y = 1"), ["g"], "x").collect()}
    assert std == {"g": None, "h": None}


def test_derived_metadata(spark):
    df = spark.createDataFrame([(["Red car", " red CAR ", "car wheel"], ["A", "B"], ["A"]), ([], [], ["A"])], "queries array<string>, supporting_titles array<string>, retrieved_titles array<string>")
    a, b = trajectories.derived_metadata(df).collect()
    assert (a.num_queries, a.num_unique_queries, a.evidence_coverage, a.has_query_refinement) == (3, 2, 0.5, True)
    assert (b.num_queries, b.num_unique_queries, b.evidence_coverage, b.has_query_refinement) == (0, 0, 0.0, False)


def test_words_of_refinements_stand_between_spaces(spark):
    df = spark.createDataFrame([(["red.\nThe car", "car.\nThe wheel"], [], []), (["the red car", "a\nred  car"], [], [])], "queries array<string>, supporting_titles array<string>, retrieved_titles array<string>")
    assert [r.has_query_refinement for r in trajectories.derived_metadata(df).collect()] == [False, True]


def test_passages_of_a_first_word_are_ranked_before_they_meet_queries(spark):
    from trailforge.plans.queries import _ByFirstWord

    passages = spark.createDataFrame([(i, str(i), "T", f"{w} {i}") for i, w in enumerate("aaaaabb")] + [(9, "9", "T", None)], "pos long, id string, title string, text string")
    queries = spark.createDataFrame([("x", "a b"), ("y", "a"), ("z", "c"), ("b", "b\n")], "qid string, query string")
    hits = _ByFirstWord(passages).search(queries, 2)
    assert sorted((r.qid, r["rank"], r.doc_id, r.text) for r in hits.collect()) == [(q, i + 1, str(i), f"a {i}") for q in "xy" for i in range(2)]
    assert "windowspecdefinition(w#" in hits._jdf.queryExecution().optimizedPlan().toString()  # not a window over the hits of a query


def test_corpus_is_numbered_without_its_texts(spark):
    rows = [("t", "b", 3), ("t", "a", 1), ("t", "a", 2), ("t", "", 0), ("t", None, 9), (None, "n", 5), (None, "n", 4), ("t", "b", 3), ("t", "c", 1), ("u", "a", 1)]
    out = corpus.build_corpus(spark.createDataFrame(rows, "title string, text string, pos int"))
    got = sorted(((r.title, r.text, r.nth) for r in out.collect()), key=str)
    assert [g for g in got if g[0] != "t"] == [("u", "a", 0), (None, "n", 0)]  # the order of a and c, which share a place, is open
    assert {g[1]: g[2] for g in got if g[0] == "t"} in ({"a": 0, "c": 1, "b": 2}, {"c": 0, "a": 1, "b": 2}) and len(got) == 5
    assert "text" not in {f.name for p in out.inputFiles() for f in spark.read.parquet(p).schema}
