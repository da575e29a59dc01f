"""Students as token tables, and rank-to-surprisal ratios from them.

A student is anything that gives (traj_id, student, pos, start, end, rank,
surprisal) rows; a neural one fits behind ``mapInArrow``. The n-gram student
here needs no model and is exact in SQL.
"""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.spans import token_type
from ..functions.text import WS
from .ordering import numbered, spread

# Fixed values of the score.
R_MAX = 100
LEAST_SURPRISAL = 1e-8
ALPHAS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
INF = float("inf")

#: Tokens that are held as Python's strings at a time.
AT_ONCE = 1 << 16
#: Different words whose counts a task holds at a time, and characters of a text that is split at once.
MOST_WORDS = 1 << 19
MOST_CHARS = 1 << 20


def text_tokens(texts: DataFrame, max_len: int | None = None, previous: bool = False) -> DataFrame:
    """(traj_id, pos, token, start, end) of white-space tokens; pos from 0, at most max_len of a text. Where texts have a column spans, tokens also
    have their type, with previous the token before (prev, null at the start of a text). A text's tokens are cut where the text is: no token is shuffled or sorted for its place."""
    more = [c for c in texts.columns if c == "spans"]
    rows = spread(texts.select("traj_id", "text", *more)).select("traj_id", *more, F.posexplode(_cut(max_len, previous)(F.col("text"))).alias("pos", "t"))
    rows = rows.select("traj_id", *more, "pos", "t.token", "t.start", "t.end", *(["t.prev"] if previous else []))
    return rows.withColumn("type", token_type(F.col("spans"), F.col("start"), F.col("end"))).drop("spans") if more else rows


def _cut(max_len: int | None, previous: bool = False):
    """A function of texts: the first max_len tokens of each, with the characters where they begin and end, and with the token before if asked."""
    kind = "array<struct<token:string,start:bigint,end:bigint" + (",prev:string>>" if previous else ">>")

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        run, tokens, starts, firsts, offsets, done = re.compile(f"[^{WS}]+", re.ASCII), [], [], [], [0], []

        def close() -> None:  # Python's strings are many times as large as Arrow's
            t, s = pa.array(tokens, pa.string()), pa.array(starts, pa.int64())
            columns = {"token": t, "start": s, "end": pc.add(s, pc.cast(pc.utf8_length(t), pa.int64()))}
            if previous:
                columns["prev"] = pa.array([None, *tokens[:-1]] if tokens else [], pa.string(), mask=np.isin(np.arange(len(tokens)), firsts))
            done.append(pa.StructArray.from_arrays(list(columns.values()), list(columns)))
            tokens.clear(), starts.clear(), firsts.clear()

        for text in texts:
            before = len(tokens)
            firsts.append(before)
            for m in itertools.islice(run.finditer(text.as_py() or ""), max_len):
                tokens.append(m.group())
                starts.append(m.start())
            offsets.append(offsets[-1] + len(tokens) - before)
            if len(tokens) > AT_ONCE:
                close()
        close()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(done))

    return cut


def kinds(starts: np.ndarray, ends: np.ndarray, spans: list[dict]) -> np.ndarray:
    """For each token of a text the place of the first span that contains it wholly; the number of spans if none does."""
    found = np.full(len(starts), len(spans))
    for i in range(len(spans) - 1, -1, -1):
        found[(starts >= spans[i]["s"]) & (ends <= spans[i]["e"])] = i
    return found


def shifted(starts: np.ndarray, ends: np.ndarray, spans: list[dict], by: int) -> list[dict]:
    """Spans of a text with both ends moved by a number of its tokens, in order (see diagnostics.shift_boundaries); those that no token meets go."""
    out = []
    for x in spans:
        met = np.flatnonzero((starts < x["e"]) & (ends > x["s"]))
        if len(met):
            first, last = max(int(met[0]) - by, 0), min(int(met[-1]) + by, len(starts) - 1)
            if first <= last:
                out.append({"s": int(starts[first]), "e": int(ends[last]), "label": "search_decision"})
    return sorted(out, key=lambda x: (x["s"], x["e"]))


def token_bags(texts: DataFrame, shift: int | None = None) -> DataFrame:
    """(traj_id, token, type, n) from texts (traj_id, text, spans): equal tokens of a text and type are one row, with their number; the first token of
    a text is left out, as it is never scored. With shift, also the type (moved) after the spans' ends are moved by so many tokens. All of it is made where the text is.
    """
    rows = texts.select("traj_id", F.col("text").cast("string").alias("text"), "spans")
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # rows go through a task some at a time, whatever their number

    def count(batches):
        run, bag, ids = re.compile(f"[^{WS}]+", re.ASCII), Counter(), {}
        names = ["traj_id", "token", "type", *([] if shift is None else ["moved"]), "n"]

        def made():  # the keys of bag are places in ids and what follows them
            columns = [list(c) for c in zip(*bag, strict=True)]
            at = pa.array(list(ids.values()), kind).take(pa.array(columns[0]))
            out = pa.RecordBatch.from_arrays([at, *(pa.array(c, pa.string()) for c in columns[1:]), pa.array(list(bag.values()), pa.int64())], names=names)
            bag.clear(), ids.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            for traj, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found, spans, me = list(run.finditer(text.as_py() or "")), spans.as_py() or [], len(ids)
                if len(found) < 2:
                    continue
                ids[me] = traj.as_py()
                starts, ends = np.array([m.start() for m in found]), np.array([m.end() for m in found])
                types = [[x[k] for k in kinds(starts, ends, which).tolist()] for which in ([spans] if shift is None else [spans, shifted(starts, ends, spans, shift)]) for x in [[s["label"] for s in which] + ["reasoning"]]]
                bag.update(itertools.islice(zip(itertools.repeat(me), (m.group() for m in found), *types), 1, None))
                if len(bag) > AT_ONCE:
                    yield made()
        if bag:
            yield made()

    more = "" if shift is None else "moved string, "
    return rows.repartition(tasks, "traj_id").mapInArrow(count, f"traj_id {rows.schema['traj_id'].dataType.simpleString()}, token string, type string, {more}n long")


def word_counts(texts: DataFrame, by: str) -> DataFrame:
    """(by, token, c) from texts (by, text): lower-cased words, counted in the task that has their texts before they are shuffled."""
    rows = spread(texts.select(by, F.lower("text").alias("text")))

    def count(batches):
        run, held = re.compile(f"[^{WS}]+", re.ASCII), {}

        def made():
            for key, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([key], kind).take(pa.array(np.zeros(len(words), np.int64))), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=[by, "token", "c"])
            held.clear()

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py() or ""
                words = held.setdefault(key, Counter())
                # str.split cuts at the same characters (a test holds them against each other), faster but all at once
                words.update(text.split() if len(text) <= MOST_CHARS else (m.group() for m in run.finditer(text)))
                if len(words) > MOST_WORDS // len(held):
                    yield from made()
        yield from made()

    parts = rows.mapInArrow(count, f"{by} {rows.schema[by].dataType.simpleString()}, token string, c long")
    return parts.groupBy(by, "token").agg(F.sum("c").alias("c"))


def unigram_vocabulary(training: DataFrame, by: str = "student") -> DataFrame:
    """(student, token, c, rank, p, oov_rank, oov_p): p = (c + 1) / (T + V + 1); rank from 0 by count, ties by token."""
    rows = numbered(word_counts(training, by), [by], [F.desc("c"), F.asc("token")], "nth")
    totals = rows.groupBy(by).agg(F.sum("c").alias("t"), F.count("*").alias("v"))
    whole = F.col("t") + F.col("v") + 1
    return rows.join(F.broadcast(totals), by).select(by, "token", "c", (F.col("nth") - 1).alias("rank"), ((F.col("c") + 1) / whole).alias("p"), F.col("v").alias("oov_rank"), (1 / whole).alias("oov_p"))


def ngram_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A token table from a vocabulary, with the tokens' type if they have one; the first token of a text is never scored (nothing predicts it).
    Bags of tokens give rows with their number (n), without places.

    Tokens are best typed before: then they are still where their text is, and meet its spans without another shuffle. A token meets
    what all students know of it at once; a row for each student is made of that.
    """
    oov = vocabulary.groupBy("student").agg(F.first("oov_rank").alias("oov_rank"), F.first("oov_p").alias("oov_p")).collect()  # a row for each student
    if not oov:
        tokens, oov = tokens.where("false"), [Row(student=None, oov_rank=0, oov_p=1.0)]
    asked = (tokens.where("pos > 0") if "pos" in tokens.columns else tokens).withColumn("key", F.lower("token"))
    own = lambda s, c: F.max(F.when(F.col("student") == F.lit(s), F.col(c)))
    known = vocabulary.groupBy(F.col("token").alias("key")).agg(*(own(o.student, c).alias(f"{c}_{i}") for i, o in enumerate(oov) for c in ("rank", "p")))
    sides = [F.struct(F.lit(o.student).cast(vocabulary.schema["student"].dataType).alias("student"), F.coalesce(f"rank_{i}", F.lit(o.oov_rank)).alias("rank"), F.coalesce(f"p_{i}", F.lit(o.oov_p)).alias("p")) for i, o in enumerate(oov)]
    more = [c for c in tokens.columns if c in ("pos", "start", "end")], [c for c in tokens.columns if c in ("type", "moved", "n")]
    rows = asked.join(known, "key", "left").select("traj_id", *more[0], *more[1], F.inline(F.array(*sides)))
    return rows.select("traj_id", "student", *more[0], "rank", (-F.ln("p")).alias("surprisal"), *more[1])


def logit_tokens(rows: DataFrame) -> DataFrame:
    """Rank and surprisal of targets from logits: rows (.., logits array, target int, 0-based)."""
    x = F.element_at("logits", F.col("target") + 1)
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda n, v: n + F.exp(v - top))
    return rows.withColumns({"rank": F.size(F.filter("logits", lambda v: v > x)).cast("long"), "surprisal": F.ln(total) + top - x})


def typed(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Token rows with their type, from (traj_id, spans)."""
    return tokens.join(spans, "traj_id").withColumn("type", token_type(F.col("spans"), F.col("start"), F.col("end"))).drop("spans")


def ratio(n: Column, ranks: Column, surprisal: Column) -> Column:
    return F.when((n == 0) | (F.coalesce(surprisal, F.lit(0.0)) < LEAST_SURPRISAL), F.lit(INF)).otherwise(F.try_divide(ranks, surprisal))


def rsr(tokens: DataFrame, r_max: int = R_MAX) -> DataFrame:
    """One row for each text and student: the full ratio, that of each token type, and counts; one pass over the tokens. A row with n stands for so many
    tokens. Where tokens have a second type (moved), the ratios by it come along as rsr_reasoning_moved and rsr_search_decision_moved."""
    n = F.col("n") if "n" in tokens.columns else F.lit(1).cast("long")
    clipped = F.least("rank", F.lit(r_max)).cast("double")
    parts = {"full": F.lit(True), "reasoning": F.col("type") == "reasoning", "search_decision": F.col("type") == "search_decision"}
    if "moved" in tokens.columns:
        parts |= {f"{k}_moved": F.col("moved") == k for k in ("reasoning", "search_decision")}
    aggs = [f for name, test in parts.items() for f in (F.sum(F.when(test, n).otherwise(0)).alias(f"n_{name}"), F.sum(F.when(test, clipped * n)).alias(f"r_{name}"), F.sum(F.when(test, F.col("surprisal") * n)).alias(f"s_{name}"))]
    mean = lambda c: F.try_divide(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n)))
    rows = tokens.groupBy("traj_id", "student").agg(*aggs, mean("rank").alias("mean_rank"), mean("surprisal").alias("mean_surprisal"))
    score = {f"rsr_{n}": ratio(F.col(f"n_{n}"), F.col(f"r_{n}"), F.col(f"s_{n}")) for n in parts}
    both = F.col("n_reasoning") + F.col("n_search_decision")
    share = F.when(both > 0, F.col("n_search_decision") / both).otherwise(0.0)
    return rows.select("traj_id", "student", F.col("n_full").alias("num_tokens"), "mean_rank", "mean_surprisal", *(c.alias(n) for n, c in score.items()), F.col("n_reasoning").alias("num_reasoning_tokens"), F.col("n_search_decision").alias("num_search_decision_tokens"), share.alias("search_decision_ratio"))


def composite(alpha: Column) -> Column:
    """(1 - alpha) * reasoning + alpha * search decision; a part without tokens leaves the other alone."""
    r, s = F.col("rsr_reasoning"), F.col("rsr_search_decision")
    return F.when(s == INF, r).when(r == INF, s).otherwise((1 - alpha) * r + alpha * s)


def sd_rsr(scores: DataFrame, alpha: float = 0.5) -> DataFrame:
    return scores.withColumns({"alpha": F.lit(float(alpha)), "sd_rsr_score": composite(F.lit(float(alpha)))})


def alpha_sweep(scores: DataFrame, alphas: tuple[float, ...] = ALPHAS, digits: int = 6) -> DataFrame:
    """Every text at every alpha with its rank there (ties by id); the sums are not taken again."""
    rows = scores.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas)))).withColumn("sd_rsr_score", F.round(composite(F.col("alpha")), digits))
    return numbered(rows, ["student", "alpha"], [F.asc("sd_rsr_score"), F.asc("traj_id")], "rnk")


def ranked(scores: DataFrame, by: str, lower_is_better: bool = True) -> DataFrame:
    return scores.orderBy(F.asc_nulls_last(by) if lower_is_better else F.desc_nulls_last(by), "traj_id")


def select_top_k(scores: DataFrame, by: str, k: int, lower_is_better: bool = True) -> DataFrame:
    return ranked(scores, by, lower_is_better).limit(k)
