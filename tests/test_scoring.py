from __future__ import annotations

import math
import re

import pytest

from trailforge.functions import spans
from trailforge.operators import diagnostics, scoring, selection

TOKENS = [("t", "s", 1, 0, 0.1, "reasoning"), ("t", "s", 2, 5, 2.0, "reasoning"), ("t", "s", 3, 250, 4.0, "reasoning"), ("t", "s", 4, 3, 1.5, "search_decision"), ("t", "s", 5, 1, 0.5, "search_decision"), ("u", "s", 1, 0, 0.0, "reasoning"), ("v", "s", 1, 9, 3.0, "search_decision")]


@pytest.fixture(scope="module")
def scores(spark):
    return scoring.rsr(spark.createDataFrame(TOKENS, "traj_id string, student string, pos int, rank long, surprisal double, type string")).cache()


def test_ratios(scores):
    by = {r.traj_id: r for r in scores.collect()}
    assert by["t"].rsr_reasoning == pytest.approx(17.2131147541)
    assert by["t"].rsr_search_decision == pytest.approx(2.0)
    assert by["t"].rsr_full == pytest.approx(13.4567901235)
    assert by["t"].mean_rank == pytest.approx(259 / 5)
    assert by["u"].rsr_full == by["u"].rsr_search_decision == math.inf
    assert by["t"].search_decision_ratio == pytest.approx(0.4)


def test_sweep(scores):
    rows = scoring.alpha_sweep(scores, digits=9).where("traj_id = 't'").orderBy("alpha").collect()
    assert [r.sd_rsr_score for r in rows] == pytest.approx([17.2131147541, 14.1704918033, 11.1278688525, 8.0852459016, 5.0426229508, 2.0])
    other = {r.traj_id: r.sd_rsr_score for r in scoring.sd_rsr(scores, 0.0).collect()}
    assert other["u"] == math.inf
    assert other["v"] == pytest.approx(3.0)  # its only part, whatever alpha is
    assert [r.traj_id for r in scoring.select_top_k(scores, "rsr_full", 3).collect()] == ["v", "t", "u"]


def test_logits(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0], 2), ([0.0, 0.0], 0)], "logits array<double>, target int")
    rows = scoring.logit_tokens(df).collect()
    total = sum(math.exp(x) for x in (1, 3, 2))
    assert (rows[0]["rank"], rows[0].surprisal) == (1, pytest.approx(math.log(total) - 2))
    assert (rows[1]["rank"], rows[1].surprisal) == (0, pytest.approx(math.log(2)))


ROWS = [("t1", "x", 5, 4, 4, 1.0, True, 1), ("t2", "x", 3, 3, 3, 0.9, True, 2), ("t3", "x", 2, 2, 4, 0.5, False, 3), ("t4", "y", 1, 1, 1, 0.5, False, 4), ("t5", "z", 1, 1, 2, 0.0, False, 5), ("t6", "y", 0, 0, None, 0.0, False, 6)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, dataset string, num_search_steps int, num_unique_queries int, num_queries int, evidence_coverage double, has_query_refinement boolean, pos int")


def ids(df):
    return [r.id for r in df.collect()]


def test_structure(rows):
    assert {r.id: r.score for r in selection.structural_score(rows).collect()} == pytest.approx({"t1": 1.0, "t2": 0.87, "t3": 0.375, "t4": 0.45, "t5": 0.175, "t6": 0.0})


def greedy(items, k, weight):
    """The rule read off its definition: the best by mixed score, the first of equals, datasets seen so far."""
    left, seen, out = sorted(items, key=lambda x: (-x[2], x[3])), set(), []
    while left and len(out) < k:
        best = max(range(len(left)), key=lambda i: ((1 - weight) * left[i][2] + weight * (left[i][1] not in seen), -i))
        x = left.pop(best)
        seen.add(x[1])
        out.append(x[0])
    return out


def test_diversity(rows):
    assert ids(selection.topocurate_selection(rows, 5, 0.3)) == ["t1", "t4", "t2", "t5", "t3"]
    assert ids(selection.topocurate_selection(rows, 5, 0.9)) == ["t1", "t4", "t5", "t2", "t3"]
    assert ids(selection.topocurate_selection(rows, 6, 0.3)) == ["t1", "t2", "t4", "t3", "t5", "t6"]
    items = [(r.id, r.dataset, r.score, r.pos) for r in selection.structural_score(rows).collect()]
    for weight in (0.1, 0.5, 1.0):
        assert ids(selection.topocurate_selection(rows, 4, weight)) == greedy(items, 4, weight)
    with pytest.raises(ValueError):
        selection.topocurate_selection(rows, 2, 1.5)


def test_random_does_not_depend_on_partitions(rows):
    assert ids(selection.random_selection(rows, 3)) == ids(selection.random_selection(rows.repartition(3), 3))
    assert len(ids(selection.random_selection(rows, 99))) == 6


def test_correct(spark):
    df = spark.createDataFrame([("a", True, 3), ("b", None, 1), ("c", True, 1), ("d", False, 2)], "id string, answer_correct boolean, pos int")
    assert ids(selection.correctness_selection(df, 5)) == ["c", "a"]
    assert len(ids(selection.correctness_selection(df, 1))) == 1


def test_methods(rows, scores, spark):
    with pytest.raises(ValueError):
        selection.select("nothing", rows)
    named = scores.withColumnRenamed("traj_id", "x").selectExpr("case x when 't' then 't1' when 'u' then 't2' else 't3' end as traj_id", "rsr_full")
    assert ids(selection.select("vanilla_rsr", rows, 2, scores=named)) == ["t3", "t1"]
    assert ids(selection.select("random", rows, 2)) == ids(selection.random_selection(rows, 2))


def test_tokens_get_places_and_types_where_their_text_is(spark, monkeypatch):
    monkeypatch.setattr(scoring, "AT_ONCE", 3)
    texts = [("a", " x \u2028yé\U0001f600 <search>q w</search>\n z"), ("b", ""), ("c", None), ("d", "\x85one\x1ctwo\u200bthree")]
    rows = spark.createDataFrame(texts, "traj_id string, text string").withColumn("spans", spans.decision_spans("text"))
    tokens = scoring.text_tokens(rows)
    assert not {"Window", "Sort", "Join"} & set(re.findall(r"[A-Z]\w+", tokens._jdf.queryExecution().optimizedPlan().toString()))
    want = [(k, i, m.group(), m.start(), m.end()) for k, t in texts for i, m in enumerate(re.finditer(r"[^\s\x85\u2028]+", t or ""))]
    assert sorted(tuple(r[c] for c in ("traj_id", "pos", "token", "start", "end")) for r in tokens.collect()) == want
    apart = scoring.typed(scoring.text_tokens(rows.drop("spans")), rows.select("traj_id", "spans"))
    key = lambda r: (r.traj_id, r.pos, r.type)
    assert sorted(map(key, tokens.collect())) == sorted(map(key, apart.collect()))
    assert scoring.text_tokens(rows.drop("spans"), 1).count() == 2


TEXTS = [("a", "Go go <search>q w</search> go Q é a b c d e f <continue> go x"), ("b", ""), ("c", None), ("d", "one"), ("e", "x <search>x x x</search> x x")]


def test_bags_score_as_their_tokens(spark):
    rows = spark.createDataFrame(TEXTS, "traj_id string, text string").withColumn("spans", spans.decision_spans("text"))
    vocabulary = scoring.unigram_vocabulary(spark.createDataFrame([("s", "go GO x é"), ("s", None), ("t", "x b b"), ("t", "")], "student string, text string"))
    tokens = scoring.text_tokens(rows)
    moved = diagnostics.shift_boundaries(rows.select("traj_id", "spans"), tokens, 2)
    bags = scoring.token_bags(rows, 2)
    assert bags.count() < tokens.where("pos > 0").count() == bags.agg({"n": "sum"}).first()[0]
    got = {(r.traj_id, r.student): r for r in scoring.rsr(scoring.ngram_tokens(bags, vocabulary)).collect()}
    for types, name in ((tokens, ""), (scoring.typed(tokens.drop("type"), moved), "_moved")):
        want = scoring.rsr(scoring.ngram_tokens(types, vocabulary)).collect()
        assert len(want) == len(got) == 4
        for r in want:
            for part in ("rsr_reasoning", "rsr_search_decision"):
                assert got[r.traj_id, r.student][part + name] == pytest.approx(r[part])
            for part in ("rsr_full", "mean_rank", "mean_surprisal", "num_tokens"):
                assert got[r.traj_id, r.student][part] == pytest.approx(r[part])


def test_words_are_counted_before_they_are_shuffled(spark):
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    assert every.split() == re.findall(f"[^{scoring.WS}]+", every, re.ASCII)
    texts = spark.createDataFrame([("s", "B b a"), (None, "b"), ("s", None), ("t", "x " * scoring.MOST_CHARS)], "student string, text string")
    counts = scoring.word_counts(texts, "student")
    assert {(r.student, r.token): r.c for r in counts.collect()} == {("s", "b"): 2, ("s", "a"): 1, (None, "b"): 1, ("t", "x"): scoring.MOST_CHARS}
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()  # no row for each word


def test_no_students_no_rows(spark):
    rows = spark.createDataFrame([("a", "x y", [])], "traj_id string, text string, spans array<struct<s:int,e:int,label:string>>")
    vocabulary = scoring.unigram_vocabulary(spark.createDataFrame([], "student string, text string"))
    assert scoring.ngram_tokens(scoring.token_bags(rows), vocabulary).count() == 0
