from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailforge.functions.spans import decision_spans
from trailforge.operators import scoring, subwords
from trailforge.plans.queries import QUERIES

PATH, BEGIN = public_tokenizers.path("byte_bpe_50k.json"), 50256
TEXTS = ["<search>red car</search> and then", "plain  words\n\nonly", "", None, "héllo 🙂👍🏽 漢字\0", " <continue> late", "x" * 500, "<search>a</search>" * 3]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "traj_id int, text string")


def expected(text, max_len=None, begin=True):
    e = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False)
    rows = [(BEGIN, 0, 0)] * begin + [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]
    return rows[:max_len]


@pytest.mark.parametrize("max_len", [None, 4, 1])
def test_tokens_are_the_librarys(spark, texts, monkeypatch, max_len):
    got: dict = {}
    for r in subwords.subword_tokens(texts, PATH, max_len, BEGIN).orderBy("traj_id", "pos").collect():
        got.setdefault(r.traj_id, []).append((r.pos, r.token_id, r.start, r.end))
    want = {i: [(p, *x) for p, x in enumerate(expected(t, max_len))] for i, t in enumerate(TEXTS)}
    assert got == want
    assert subwords.subword_tokens(texts.limit(0), PATH).count() == 0


def test_tokens_rebuild_the_texts(texts):
    back = {r.traj_id: r for r in subwords.decoded(subwords.subword_tokens(texts, PATH, None, BEGIN), PATH).collect()}
    assert {i: r.text for i, r in back.items()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {i: (r.last_end, r.n_without_width) for i, r in back.items()} == {i: (len(t or ""), 1) for i, t in enumerate(TEXTS)}


def test_tokens_are_typed_by_containment(texts):
    """A token belongs to a span only as a whole; the one without width only to a span that starts with the text."""
    spans = texts.select("traj_id", decision_spans("text").alias("spans"))
    where = {r.traj_id: [(s.s, s.e) for s in r.spans] if r.spans else [] for r in spans.collect()}
    for r in scoring.typed(subwords.subword_tokens(texts, PATH, None, BEGIN), spans.where("spans is not null")).collect():
        inside = any(r.start >= s and r.end <= e for s, e in where[r.traj_id])
        assert r.type == ("search_decision" if inside else "reasoning")
        if r.pos == 0:
            assert (r.start, r.end) == (0, 0) and inside == (r.traj_id in (0, 7))
        if where[r.traj_id] and any(r.start < e < r.end or r.start < s < r.end for s, e in where[r.traj_id]):
            assert r.type == "reasoning"


def test_registered_types_are_those_of_plain_counting(spark):
    sf = "/root/testdata/sf0.001"
    from trailforge.operators import trajectories

    rows = trajectories.from_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).select("id", "text", decision_spans("text").alias("spans")).collect()
    want: dict = {}
    for r in rows:
        for p, (_, a, b) in enumerate(expected(r.text, 4096)):
            kind = "search_decision" if any(a >= s.s and b <= s.e for s in r.spans) else "reasoning"
            n, first, last = want.get((r.id, kind), (0, p, 0))
            want[r.id, kind] = (n + 1, first, max(last, b))
    got = {(r.traj_id, r.type): (r.n, r.first, r.last_end) for r in QUERIES["subword_types"](spark, sf).collect()}
    assert got == want


def test_types_are_found_where_the_text_is(texts):
    spans = texts.select("traj_id", decision_spans("text").alias("spans"))
    with_spans = texts.withColumn("spans", decision_spans("text"))
    tokens = subwords.subword_tokens(with_spans, PATH, None, BEGIN)
    assert "Join" not in tokens._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: (r.traj_id, r.pos, r.token_id, r.start, r.end, r.type)
    assert sorted(map(key, tokens.collect())) == sorted(map(key, scoring.typed(subwords.subword_tokens(texts, PATH, None, BEGIN), spans).collect()))
