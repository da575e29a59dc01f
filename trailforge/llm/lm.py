"""Scores of whole documents by a gated recurrent language model (see gru.py).

Tokens are words and one end for each text. Counts of all training tokens come
first. The ``most_words`` most frequent words (found by a histogram of counts, so
that no more than that reach the driver) are the known table that executors
hold; of them the ``n_words`` most frequent have an output of their own, and every
other word belongs to a rare class by its last two characters. Within a rare
class a word has probability (c + 0.5) / (N_r + 0.5 (V_r + 1)) from the counts
of all training tokens, one share being left for words never met; so the
model's probabilities sum to one. At its start the network's output is the
unigram distribution, and every training document then changes it: documents
are dealt into ``rounds`` by a hash of their identifier and codes, in a round each partition
trains on its documents from the shared parameters, and the results are
averaged, weighted by tokens. Unless given, the number of rounds grows with the
corpus, by one for each doubling of the training tokens beyond ROUND_TOKENS: more data come with more
partitions, and more averages let them learn from each other.

Counts of words outside the known table are found by a join: each document
sends the words it doesn't find, with their number.

Defined results: a null text is empty (one token, the end); texts are scored whole, however long, the state
going on to their end; a null identifier counts as training; repeated rows are scored and counted each; words of
equal counts are ranked by themselves; without any training token every count is 0, and the model is uniform; an
empty table gives no rows; columns beyond doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, store, tables, text_or_empty, tidily, words_of
from .gru import Adam, Model, Shape

END = "\n"  # no word has white space
LONGEST = 64
ROUND_TOKENS = 1 << 22


def rounds_for(tokens: int) -> int:
    """Rounds of training on so many tokens."""
    return 2 + max(0, math.ceil(math.log2(max(1, tokens) / ROUND_TOKENS)))


def rare_class(word: str, n_rare: int) -> int:
    return zlib.crc32(word[-2:].encode()) % n_rare


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame, n_rare: int) -> DataFrame:
    """(word, c, rare): counts of all tokens, summed in each task before the shuffle; rare: the class a rare word has."""

    def count(batches):
        import pyarrow as pa

        def out():
            rare = [rare_class(w, n_rare) for w in counts]
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(rare, pa.int32())], ["word", "c", "rare"])
            counts.clear()
            return batch

        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
            counts[END] += batch.num_rows
            if len(counts) > 300_000:
                yield out()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(tidily(count), "word string, c long, rare int").groupBy("word").agg(F.sum("c").alias("c"), F.first("rare").alias("rare"))


def known_words(counts: DataFrame, most_words: int) -> tuple[list[tuple[str, int]], int]:
    """The most frequent words, most_words at most, and the least count of them: every word of at most
    LONGEST characters with that count is among them."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64)
    short = counts.where(f"length(word) <= {LONGEST}")
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # 64 for each doubling
    total, least = 0, None
    for s in sorted(steps, key=lambda s: -s.step):
        total += s.n
        if total > most_words:
            break
        least = s.least
    if least is None:
        return [], 1 << 62
    found = [(r.word, r.c) for r in short.where(F.col("c") >= least).select("word", "c").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0])), least


class Coder:
    """What a worker needs to turn words into codes and counts."""

    def __init__(self, known: list[tuple[str, int]], shape: Shape, rare_total: list[float], n: int, v: int):
        self.known, self.shape, self.rare_total, self.n, self.v = known, shape, rare_total, n, v

    def build(self) -> Coder:
        s = self.shape
        self.number = {w: i for i, (w, _) in enumerate(self.known)}
        c = np.array([c for _, c in self.known], np.float64)
        self.code = np.arange(len(self.known), dtype=np.int32)
        rare = np.arange(len(self.known)) >= s.n_words
        self.code[rare] = [s.n_words + rare_class(w, s.n_rare) for w, _ in self.known[s.n_words :]]
        self.log_c = np.log10(c + 0.5)
        self.rare_log = np.log10(np.array(self.rare_total))
        return self

    def kind(self) -> str:
        """The type that holds every code."""
        return "<u1" if self.shape.n_words + self.shape.n_rare <= 256 else "<u2"

    def end_code(self) -> int:
        return next(i for i, (w, _) in enumerate(self.known) if w == END)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(codes, numbers of known words or -1, the words not known)."""
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        code = self.code[number]
        rest = np.flatnonzero(number < 0)
        lost = [words[i] for i in rest.tolist()]
        if lost:
            n = self.shape.n_rare
            code[rest] = [self.shape.n_words + rare_class(w, n) for w in lost]
        return code, number, lost


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """The coder of a broadcast, built once in a worker."""
    got = shared.value
    if id(got) not in _coders:
        _coders.clear()
        _coders[id(got)] = got.build()
    return got


def _blocks(batches, columns: list[str], most_chars: int = 3 << 20):
    """Rows of a few batches together: lists of the columns."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            for x, v in zip(held, row, strict=True):
                x.append(v)
            size += len(row[-1]) + 1
            if size >= most_chars:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Each text as codes, so that it is read and cut into words once: doc_id, held_out, codes, n_tokens, known (its
    known tokens), log_c (their sum of log10(c + 0.5)), extra (the part of the score within rare classes), lost."""

    def work(batches):
        import pyarrow as pa

        own = _coder(shared)
        end, n_words = own.number[END], own.shape.n_words
        end_count = own.known[end][1]
        for ids, held, texts in _blocks(batches, ["doc_id", "held_out", "text"], 1 << 20):
            codes, n_tokens, n_known, log_c, extra, lost = [], [], [], [], [], []
            for t in texts:
                code, number, missing = own.codes(words_of(t))
                met = number[number >= 0]
                n_tokens.append(len(code) + 1)
                n_known.append(len(met) + (end_count > 0))
                log_c.append(float(own.log_c[met].sum() + own.log_c[end]))
                extra.append(float(own.log_c[met[met >= n_words]].sum() - own.rare_log[code[code >= n_words] - n_words].sum()))
                lost.append(Counter(missing))
                codes.append(np.append(code, own.code[end]).astype(own.kind()).tobytes())
            sent = pa.StructArray.from_arrays([pa.array(chain.from_iterable(lost), pa.string()), pa.array(chain.from_iterable(c.values() for c in lost), pa.int32())], ["word", "n"])
            sent = pa.ListArray.from_arrays(np.cumsum([0, *map(len, lost)], dtype=np.int32), sent)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(codes, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_c), pa.array(extra), sent], ["doc_id", "held_out", "codes", "n_tokens", "known", "log_c", "extra", "lost"])

    rows = docs.withColumn("held_out", held_out()).select("doc_id", "held_out", "text")
    rows = rows.mapInArrow(tidily(work), "doc_id long, held_out boolean, codes binary, n_tokens long, known long, log_c double, extra double, lost array<struct<word:string,n:int>>")
    return store(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def train(texts: DataFrame, shared, flat: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Parameters after training on every encoded text (row, codes) once."""
    shape = shared.value.shape
    for turn in range(rounds):
        part = texts.where(F.pmod(F.xxhash64("doc_id", "codes"), F.lit(rounds)) == turn).select("codes")

        def learn(batches, flat=flat):
            import pyarrow as pa
            from pyspark import TaskContext

            own = shared.value
            end = own.end_code()
            model, adam, tokens = Model(shape, flat.copy()), Adam(shape, rate), 0
            for (codes,) in _blocks(batches, ["codes"], 1 << 20):
                codes = [np.frombuffer(c, own.kind()).astype(np.int32) for c in codes]
                model.run(codes, end, adam)
                tokens += sum(map(len, codes))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(model.flat.astype(np.float64) * tokens).tobytes()], pa.binary())], ["part", "tokens", "sums"])

        def add(group):
            import pyarrow as pa

            total = np.zeros(shape.size())
            for b in group.column("sums").to_pylist():
                total += np.frombuffer(b)
            return pa.table([pa.array([0], pa.int64()), pa.array([sum(group.column("tokens").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "tokens", "sums"])

        kind = "part long, tokens long, sums binary"
        # partitions' results meet in at most 32 sums, which come to the driver
        sums = part.mapInArrow(tidily(learn), kind).groupBy(F.col("part") % 32).applyInArrow(add, kind).collect()
        if sums:
            flat = (sum(np.frombuffer(r.sums) for r in sums) / sum(r.tokens for r in sums)).astype(np.float32)
    return flat


def lm_scores(docs: DataFrame, n_words: int = 256, width: int = 32, n_rare: int = 88, state: int = 12, embed: int = 12, most_words: int = 1 << 18, rounds: int | None = None, rate: float = 0.01) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    training = docs.where(~held_out())
    counts = store(count_words(training, n_rare), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known, least = known_words(counts, most_words)
    if not any(w == END for w, _ in known):
        known = [*known, (END, 0)] if not known else sorted([*known, (END, counts.where(F.col("word") == END).select("c").first()[0])], key=lambda x: (-x[1], x[0]))
    own = max(1, min(n_words, len(known)))
    if END not in {w for w, _ in known[:own]}:
        known = [k for k in known if k[0] == END] + [k for k in known if k[0] != END]
    shape = Shape(own, width, n_rare, embed, state)
    frequent = [w for w, _ in known[:own]]
    mass = {r.rare: (r.c, r.v) for r in counts.where(~F.col("word").isin(frequent)).groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    rare_total = [mass.get(r, (0, 0))[0] + 0.5 * (mass.get(r, (0, 0))[1] + 1) for r in range(n_rare)]
    words = np.array([c + 0.5 for _, c in known[:own]])
    classes = np.concatenate([np.add.reduceat(words, np.arange(0, own, width)), rare_total])
    coder = Coder(known, shape, rare_total, n, v)
    shared = spark.sparkContext.broadcast(coder)
    texts = encoded(docs, shared)
    flat = train(texts.where("not held_out"), shared, shape.start(classes / classes.sum(), words), rounds or rounds_for(n), rate)
    weights = spark.sparkContext.broadcast(flat)

    def score(batches):
        import pyarrow as pa

        own = shared.value
        model, end = Model(own.shape, weights.value), own.end_code()
        for rows, codes in _blocks(batches, ["row", "codes"], 1 << 22):
            logp = model.run([np.frombuffer(c, own.kind()).astype(np.int32) for c in codes], end) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(logp)], ["row", "model"])

    scored = texts.select("row", "codes").mapInArrow(tidily(score), "row long, model double")
    # words with the least known count and more are in the table, the long ones apart
    rest = counts.where((F.col("c") < least) | (F.length("word") > LONGEST)).select("word", "c")
    sent = texts.select("row", F.explode("lost").alias("l")).select("row", "l.word", "l.n")
    c = F.coalesce("c", F.lit(0))
    more = sent.join(rest, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("more_c"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
    total = math.log10(n + 0.5 * (v + 1))
    done = texts.drop("lost", "codes").join(scored, "row").join(more, "row", "left")
    extra_c = F.coalesce("more_c", F.lit(0.0))
    return done.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("log_c") + extra_c - F.col("n_tokens") * total).alias("base_score"), (F.col("model") + F.col("extra") + extra_c).alias("score"))


def op5_gru_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(tables(spark, sf_dir, "documents"))
