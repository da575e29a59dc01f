from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailforge.functions import spans as sp
from trailforge.operators import scoring
from trailforge.plans.prompts import FEW_SHOT


def spans(spark, text, **how):
    row = spark.createDataFrame([(text,)], "text string").select(sp.decision_spans("text", **how).alias("s")).first()
    return [(x.s, x.e) for x in row.s]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<search>a</search> x <continue> <search>b\nc</search><search>open", [(0, 18), (21, 31), (32, 52), (52, 60)]),
        ("<search>a <search>b</search>", [(0, 28)]),
        ("é😀<search>日本</search>", [(2, 21)]),
        ("no", []),
        ("", []),
    ],
)
def test_base_spans(spark, text, want):
    assert spans(spark, text) == want


def test_other_tags_and_markers(spark):
    assert spans(spark, "[q]x[/q] [q] <go>", start="[q]", end="[/q]", markers=["<go>"]) == [(0, 8), (13, 17)]
    assert spans(spark, "<search> a", markers=[]) == [(0, 8)]


def test_extended_spans(spark):
    text = "<think>I know. Let me search for it. First, find x</think>Let me search"
    assert [text[s:e] for s, e in spans(spark, text, extended=True)] == [" Let me search for it.", " First, find x"]
    assert spans(spark, text) == []


def test_transcripts_of_the_prompt(spark):
    for shot, n in ((FEW_SHOT[1][1], 2), (FEW_SHOT[3][1], 3)):
        found = spans(spark, shot)
        assert len(found) == n
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert 0.02 < sum(e - s for s, e in found) / len(shot) < 0.30
        assert all(shot[s:e].startswith("<search>") and shot[s:e].endswith("</search>") for s, e in found)


def test_token_types_need_containment(spark):
    df = spark.createDataFrame([("t", "ab <search>q</search> cd")], "traj_id string, text string")
    tokens = scoring.text_tokens(df)
    rows = scoring.typed(tokens, df.select("traj_id", sp.decision_spans("text").alias("spans"))).orderBy("pos").collect()
    assert [(r.token, r.start, r.end, r.type) for r in rows] == [("ab", 0, 2, "reasoning"), ("<search>q</search>", 3, 21, "search_decision"), ("cd", 22, 24, "reasoning")]
    assert scoring.text_tokens(df, 2).count() == 2
    straddling = spark.range(1).select(sp.token_type(F.array(F.struct(F.lit(3).alias("s"), F.lit(9).alias("e"), F.lit("search_decision").alias("label"))), F.lit(8), F.lit(10)))
    assert straddling.first()[0] == "reasoning"


def test_synthesis_phrases(spark):
    text = "<think>I need to search for x. Based on the search results, it is y. I like results.\nThe passages say so!</think> Based on these results <think>I can now answer. From my evidence</think><search>a</search>"
    cut = lambda **how: [text[s.s : s.e] for s in spark.createDataFrame([(text,)], "text string").select(sp.decision_spans("text", **how).alias("x")).first().x]
    assert cut() == ["<search>a</search>"]
    assert cut(synthesis=True) == [" Based on the search results, it is y.", "The passages say so!", "I can now answer.", " From my evidence", "<search>a</search>"]
    assert cut(extended=True, synthesis=True)[0] == "I need to search for x." and len(cut(extended=True, synthesis=True)) == 6
