from __future__ import annotations

import math

import pytest

from trailforge.operators import context, ordering, scoring

TEXTS = [("s", "a b a c a b d b a"), ("s", "b a b b e"), ("s", ""), ("s", None), ("s", "lone"), ("t", "A b a c"), ("t", "x y x z x w x v x u x t")]


def model(student):
    """Unigram probabilities and order, and the counts of continuations, by plain counting."""
    words = [t.lower().split() for s, t in TEXTS if s == student and t]
    uni: dict = {}
    after: dict = {}
    for w in words:
        for t in w:
            uni[t] = uni.get(t, 0) + 1
        for u, t in zip(w, w[1:]):
            after.setdefault(u, {})[t] = after.setdefault(u, {}).get(t, 0) + 1
    whole = sum(uni.values()) + len(uni) + 1
    order = sorted(uni, key=lambda t: (-uni[t], t)) + [None]  # None: all unknown words
    return {t: (uni.get(t, 0) + 1) / whole for t in order}, order, after


def expected(student, prev, token):
    p, order, after = model(student)
    token = token if token in p else None
    if prev not in after:
        return order.index(token), p[token]
    seen = sorted(after[prev], key=lambda t: (-after[prev][t], t))
    escape = sum(after[prev].values()) + 1
    rest = [t for t in order if t not in after[prev]]
    if token in after[prev]:
        return seen.index(token), after[prev][token] / escape
    return len(seen) + rest.index(token), p[token] / escape / sum(p[t] for t in rest)


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_ranks_and_probabilities_in_context(spark, monkeypatch, most):
    monkeypatch.setattr(ordering, "MOST_IN_TASK", most)
    student = context.ContextStudent(spark.createDataFrame(TEXTS, "student string, text string"))
    words = [*"abcdexyzwvut", "lone", "unknown", "other"]
    asked = spark.createDataFrame([(u, t) for u in words for t in words], "prev string, token string")
    got = {(r.student, r.prev, r.token): (r["rank"], r.p) for r in student.pairs(asked).collect()}
    assert len(got) == 2 * len(words) ** 2
    for (s, u, t), (rank, p) in got.items():
        want = expected(s, u, t)
        assert rank == want[0] and p == pytest.approx(want[1])
    for s in ("s", "t"):
        p, order, _ = model(s)
        for u in words:  # a context's probabilities add up to one, and fall with the rank
            given = sorted(got[s, u, t or "unknown"] for t in order)
            assert sum(x for _, x in given) == pytest.approx(1)
            assert [r for r, _ in given] == list(range(len(order)))
            assert all(a[1] >= b[1] - 1e-12 for a, b in zip(given, given[1:]))


def test_tokens_of_texts_in_context(spark):
    student = context.ContextStudent(spark.createDataFrame(TEXTS, "student string, text string"))
    tokens = scoring.text_tokens(spark.createDataFrame([("x", "A  b\nnew c"), ("y", "one"), ("z", "")], "traj_id string, text string"))
    got = {(r.student, r.pos): (r["rank"], r.surprisal, r.start, r.end) for r in student.tokens(tokens).collect()}
    assert set(got) == {(s, i) for s in "st" for i in (1, 2, 3)}
    for s in "st":
        for i, (u, t, a, b) in enumerate([("a", "b", 3, 4), ("b", "new", 5, 8), ("new", "c", 9, 10)], 1):
            rank, p = expected(s, u, t)
            assert got[s, i] == (rank, pytest.approx(-math.log(p)), a, b)


def test_a_student_of_nothing(spark):
    student = context.ContextStudent(spark.createDataFrame([], "student string, text string"))
    tokens = scoring.text_tokens(spark.createDataFrame([("x", "a b")], "traj_id string, text string"))
    assert student.tokens(tokens).count() == 0


def test_a_context_is_dealt_once(spark):
    """Continuations and asked words meet after one shuffle by their context, where each of several tables was sorted and numbered on its own; the token before comes with the cut."""
    student = context.ContextStudent(spark.createDataFrame(TEXTS, "student string, text string"))
    plan = student.pairs(spark.createDataFrame([("a", "b"), ("a", "e")], "prev string, token string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [student") == 1 and "SortMergeJoin" not in plan
    texts = spark.createDataFrame([("1", "a b  c"), ("2", ""), ("3", None), ("4", "d e")], "traj_id string, text string")
    cut = scoring.text_tokens(texts, previous=True)
    assert sorted((r.traj_id, r.pos, r.token, r.prev) for r in cut.collect()) == [("1", 0, "a", None), ("1", 1, "b", "a"), ("1", 2, "c", "b"), ("4", 0, "d", None), ("4", 1, "e", "d")]
    assert sorted(map(tuple, context.with_previous(cut.drop("prev")).select(*cut.columns).collect())) == sorted(map(tuple, cut.collect()))
