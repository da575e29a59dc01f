from __future__ import annotations

import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailforge.functions import text as tx


def column(spark, values, expression, names=("a", "b")):
    values = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} string" for n, _ in zip(names, values[0], strict=False)))
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


PAIRS = [
    ("The Eiffel Tower", "eiffel tower!", 1, 1),
    ("the red red car", "red car car", 0, 2 / 3),
    ("red red car", "red red bus", 0, 2 / 3),
    ("", "the", 1, 1),
    ("x", "a", 0, 0),
    ("the_cat", "the cat", 0, 0),
    ("Paris, France", "Paris", 0, 2 / 3),
]


def test_exact_match_and_f1(spark):
    pairs = [p[:2] for p in PAIRS]
    assert column(spark, pairs, tx.exact_match("a", "b")) == [p[2] for p in PAIRS]
    assert column(spark, pairs, tx.token_f1("a", "b")) == pytest.approx([p[3] for p in PAIRS])


def test_normalize_order(spark):
    assert column(spark, ["the-cat", "the_cat", "A  b　an", "naïve the", "theater"], tx.normalize_answer("a")) == ["cat", "thecat", "b", "naïve", "theater"]


def test_extract_answer(spark):
    cases = {
        "so the answer is: Paris. And more": "Paris",
        "Answer: 3.14": "3",
        "Answer: first\nFINAL ANSWER  Rome": "Rome",
        "one\n two \n\n": "two",
        "": "",
        "answer: a\nmore text": "more text",
        "Answer: yes\n": "yes",
    }
    assert column(spark, list(cases), tx.extract_answer("a")) == list(cases.values())


def test_tokens_split_at_all_white_space(spark):
    assert column(spark, ["A B\x1cC\x85d e f,"], tx.tokenize("a")) == [["a", "b", "c", "d", "e", "f,"]]


words = st.lists(st.sampled_from(["red", "car", "blue", "x1"]), max_size=6)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_f1_is_a_bag_measure(spark, pairs):
    def model(p, g):
        if not g:
            return float(not p)
        both = sum((Counter(p) & Counter(g)).values())
        return 2 * both / (len(p) + len(g)) if both else 0.0

    got = column(spark, [(" ".join(p), " ".join(g)) for p, g in pairs], tx.token_f1("a", "b"))
    assert got == pytest.approx([model(p, g) for p, g in pairs])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aTthen ,.!_-\n", max_size=20), min_size=1, max_size=8))
def test_normalized_text_has_no_punctuation_or_articles_alone(spark, texts):
    for x in column(spark, texts, tx.normalize_answer("a")):
        assert not set(x) & set(string.punctuation)
        assert x == " ".join(x.split())


def test_tsv_and_context(spark):
    assert column(spark, ["a\tb\nc"], tx.tsv_safe("a")) == ["a b c"]
    assert column(spark, [("T", "abcdef")], tx.context_string("a", "b", 3)) == ["[T] abc"]
    assert column(spark, ["x"], F.lit(None).cast("string")) == [None]
