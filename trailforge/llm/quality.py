"""Quality rules with risk-controlled thresholds.

Every document gets a few rule values (shares of symbols, of repeated words and
lines, of capitals, ...). A value's scale comes from good documents of one half
of the labelled rows; a document's score is its worst scaled value. On the other
half (the holdout) the cutoff of each stratum is chosen among a fixed sequence
of cutoffs, from mild to strict: a cutoff is admitted if the exact binomial test
shows, at level delta divided by the number of strata (Bonferroni), that it
rejects less than ``max_false`` of good documents, and testing stops at the
first that fails (fixed-sequence testing, so the cutoffs of a stratum share one
level). Among admitted cutoffs the one with the best catch of bad documents
less a price for lost good ones is taken, the milder of equals. So with
probability 1 - delta no stratum loses more than ``max_false`` of its good
documents to the method's verdict.

The trials of the binomial test are distinct texts of a stratum: copies of a text are one
trial, and the halves are split by a hash of the text, so that copies never stand in both.

Defined results: a null or empty text has no words and fails the base rule; texts are read whole, however long;
a null stratum is a stratum of its own, apart from the empty one; a stratum with too few labels, or an empty
labels table, gets no cutoff, and the method keeps its documents; an empty documents table gives no rows;
labels with null values or without a document count nowhere, nor do identifiers or texts with contradictory
labels, nor identifiers that several texts have; a label given twice counts once; repeated rows each get their
own row; scores equal to the cutoff are kept. Columns of the input that have the names of new columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches, store, tables, whole_row

CUTOFFS = (16.0, 12.0, 8.0, 6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.1, 1.0)
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, rules array<double>"
N_RULES = 7
_SYMBOL = re.compile(r"[#*$%&|<>]")
_EXCLAIM = re.compile(r"[!?]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


def text_features(text: str | None) -> tuple:
    """The counts of one whole text and its rule values (higher is worse)."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
            seen.add(line)
    lines = len(seen) + dup
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            reach = 0  # words before this number are counted or passed
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(reach, i)
                    reach = i + 3
    per = max(n, 1)
    rules = [symbols / per, dup / max(lines, 1), repeat / per, len(_UPPER.findall(text)) / max(chars, 1), len(_EXCLAIM.findall(text)) / per, len(_DIGIT.findall(text)) / max(chars, 1), chars / per]
    return n, chars, symbols, dup, repeat, rules


def features(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(text_features, text)), columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "rules"])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoff(good: list[int], n_good: int, bad: list[int], n_bad: int, max_false: float, level: float, price: float = 20.0) -> float | None:
    """The cutoff of one stratum; good and bad: how many each of CUTOFFS rejects in the holdout."""
    best, worth = None, 0.0
    for cutoff, g, b in zip(CUTOFFS, good, bad, strict=True):
        if not n_good or binomial_cdf(g, n_good, max_false) > level:
            break
        value = b / max(n_bad, 1) - price * g / n_good
        if value > worth:
            best, worth = cutoff, value
    return best


def scored(docs: DataFrame, stratum: str = "lang", keep_text: bool = False) -> DataFrame:
    """A row for each of docs: __id, __row (its columns, with the text only if asked for), __q (features), __stratum, __text (a hash)."""
    bound_batches(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))
    kept = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("__id"), F.struct(*kept).alias("__row"), F.pandas_udf(features, FEATURES)(text).alias("__q"), key.alias("__stratum"), F.xxhash64(text).alias("__text"))


def _by_stratum(rows: DataFrame, limits: DataFrame, how: str = "inner", most_strata: int = 10_000) -> DataFrame:
    """rows with the stored row of their stratum: broadcast where these are few, else joined by stratum."""
    return rows.join(F.broadcast(limits) if limits.count() <= most_strata else limits, "__stratum", how)


def base_failed():
    return (F.col("__q.n_words") < 50) | (100 * F.col("__q.n_repeat_words") > 50 * F.col("__q.n_words"))


def cutoffs(docs: DataFrame, labels: DataFrame, max_false: float, delta: float) -> tuple[DataFrame, DataFrame]:
    """(scale of each stratum's rules, cutoff of each stratum) from scored docs and labels.

    Both have a row for each stratum; what reaches Python is a row for each
    stratum and cutoff count, computed on executors.
    """
    quality = F.col("quality").cast("int")
    known = labels.select(F.col("doc_id").alias("__id"), quality.alias("quality")).where("quality is not null")
    known = known.groupBy("__id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    own = docs.where(~base_failed()).select("__id", "__text", "__stratum", "__q.rules").join(known, "__id")
    own = own.groupBy("__id").agg(F.min(F.struct("__text", "__stratum", "rules")).alias("x"), F.max("__text").alias("other"), F.min("quality").alias("quality")).where("x.__text = other")
    texts = own.select("x.*", "quality").groupBy("__stratum", "__text").agg(F.min("rules").alias("rules"), F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    labelled = store(texts.withColumn("fit", F.pmod(F.xxhash64("__text", F.lit(1)), F.lit(2)) == 0), "labelled")
    value = [F.col("rules")[i] for i in range(N_RULES)]
    scale = (
        labelled.where("fit and quality = 1")
        .groupBy("__stratum")
        .agg(*(F.percentile_approx(v, [0.5, 0.99], 1000).alias(f"p{i}") for i, v in enumerate(value)))
        .select("__stratum", *(F.col(f"p{i}")[0].alias(f"mid{i}") for i in range(N_RULES)), *(F.greatest(F.col(f"p{i}")[1] - F.col(f"p{i}")[0], F.lit(0.02)).alias(f"wide{i}") for i in range(N_RULES)))
    )
    scale = store(scale, "scale")
    held = _by_stratum(labelled.where("not fit"), scale).withColumn("score", score())
    counts = held.groupBy("__stratum").agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("n_good"),
        F.sum((F.col("quality") == 0).cast("long")).alias("n_bad"),
        F.array(*(F.sum(((F.col("quality") == 1) & (F.col("score") > c)).cast("long")) for c in CUTOFFS)).alias("good"),
        F.array(*(F.sum(((F.col("quality") == 0) & (F.col("score") > c)).cast("long")) for c in CUTOFFS)).alias("bad"),
    )
    strata = counts.agg(F.count("*").alias("strata"))

    @F.pandas_udf("double")
    def pick(n_good: pd.Series, n_bad: pd.Series, good: pd.Series, bad: pd.Series, strata: pd.Series) -> pd.Series:
        return pd.Series([choose_cutoff(list(g), int(ng), list(b), int(nb), max_false, delta / max(int(s), 1)) for ng, nb, g, b, s in zip(n_good, n_bad, good, bad, strata, strict=True)], dtype="float64")

    picked = counts.join(F.broadcast(strata)).select("__stratum", "n_good", "n_bad", pick("n_good", "n_bad", "good", "bad", "strata").alias("cutoff"))
    return scale, picked


def score():
    """The worst scaled rule value; the mean word length counts in both directions."""
    terms = [(F.col("rules")[i] - F.col(f"mid{i}")) / F.col(f"wide{i}") for i in range(N_RULES)]
    return F.greatest(*terms[:-1], F.abs(terms[-1]))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = 0.01, delta: float = 0.05, keep_text: bool = False) -> DataFrame:
    """Verdict of every document: columns of docs plus features, score, cutoff, base_failed, kept.

    Without keep_text the text column is dropped. Each text is read once by
    Python; the scored rows go to the shared folder, and two joins with a
    row for each stratum follow (broadcast up to 10,000 strata).
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "cutoff", "base_failed", "kept")
    old = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    docs = store(scored(docs, stratum, keep_text), "quality")
    scale, picked = cutoffs(docs, labels, max_false, delta)
    limits = store(scale.join(picked.select("__stratum", "cutoff"), "__stratum"), "cutoffs")
    rows = _by_stratum(docs.select("*", F.col("__q.rules").alias("rules")), limits, "left")
    failed = base_failed()
    return rows.select(
        *(F.col("__row")[c].alias(c) for c in old),
        *(F.col(f"__q.{c}").alias(c) for c in new[:5]),
        score().alias("score"),
        F.col("cutoff"),
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(score() > F.col("cutoff"), F.lit(False))).alias("kept"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with their own columns."""
    marked = docs.select(whole_row(docs).alias("__row"), *(c for c in ("doc_id", "lang", "text")))
    return quality_verdicts(marked, labels, **how).where("kept").select("__row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_verdicts(docs, tables(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cutoff")
