"""A student that predicts a token from the one before: rank and surprisal in context, exact and without a model file.

The token after a context u comes from u's continuations in the training texts, or by an escape of one count from all other words:

* seen w:   P(w | u) = c(u, w) / (c(u) + 1)
* unseen w: P(w | u) = p(w) / ((c(u) + 1) (1 - S(u))), S(u) the unigram probability p of all that u was seen with
* a context that was never seen: P(w | u) = p(w)

so the probabilities of a context, with one for all unknown words together, add up to one, and a seen word is never
less probable than an unseen one. The rank, from 0, is the place in that order: seen words by count (ties by token), then the rest by unigram rank. An
unseen word's place among the rest needs the number of seen ones before it. Continuations and asked words of a context meet in one task, after one shuffle;
contexts of more than MOST_IN_TASK continuations are numbered by ranges instead.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import stored
from . import ordering
from .ordering import numbered, spread
from .retrieval import small
from .scoring import unigram_vocabulary

PAIR = ["student", "prev", "token"]


def with_previous(tokens: DataFrame) -> DataFrame:
    """Token rows with the token before (prev); null at the start of a text."""
    return tokens.withColumn("prev", F.lag("token").over(Window.partitionBy("traj_id").orderBy("pos")))


class ContextStudent:
    """Students trained on texts (student, text).

    vocabulary: as unigram_vocabulary has it; continuations(student, prev, token, c, place, p, nth), nth from 1 and place the
    unigram rank; contexts(student, prev, total, n, mass): c(u), the number of continuations, S(u).
    """

    def __init__(self, training: DataFrame):
        self.vocabulary = stored(unigram_vocabulary(training), "vocabulary")
        words = spread(training.select("student", "text")).select("student", tokenize("text").alias("w")).where(F.size("w") > 1)
        pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("prev"), b.alias("token")))
        counts = words.select("student", F.explode(pairs).alias("x")).groupBy("student", "x.prev", "x.token").agg(F.count("*").alias("c"))
        known = self.vocabulary.select("student", "token", F.col("c").alias("alone"), F.col("rank").alias("place"), "p")
        self._counts = counts.join(small(known, self.vocabulary.count()), ["student", "token"])
        self.contexts = self._counts.groupBy("student", "prev").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.sum("p").alias("mass"))

    @cached_property
    def continuations(self) -> DataFrame:
        return self._numbered(self._counts.drop("alone"))

    def _numbered(self, counts: DataFrame) -> DataFrame:
        return numbered(counts, ["student", "prev"], [F.desc("c"), F.asc("token")], "nth")

    def pairs(self, asked: DataFrame) -> DataFrame:
        """(student, prev, token, rank, p) of distinct (prev, token), for every student."""
        asked = stored(asked, "asked")
        oov = stored(self.vocabulary.groupBy("student").agg(F.first("oov_rank").alias("oov_rank"), F.first("oov_p").alias("oov_p")), "unknown")  # a row a student
        known = self.vocabulary.select("student", "token", "rank", "p", F.col("c").alias("alone"))
        rows = asked.crossJoin(F.broadcast(oov)).join(known, ["student", "token"], "left")
        rows = rows.select(*PAIR, F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("rank", "oov_rank").alias("place"), F.coalesce("p", "oov_p").alias("p"))
        contexts = asked.select("prev").distinct()
        counts = self._counts.join(small(contexts, contexts.count()), "prev", "left_semi")
        most = ordering.MOST_IN_TASK
        if (oov.agg(F.max("oov_rank")).first()[0] or 0) <= most:
            return self._by_context(rows, counts, oov)
        # a context has no more continuations than its word has places, nor than there are words
        large = self.vocabulary.where(F.col("c") > most).select("student", F.col("token").alias("prev"))
        rows, counts = stored(rows, "asked-places"), stored(counts, "asked-counts")
        side = lambda how: tuple(t.join(large, ["student", "prev"], how) for t in (rows, counts))
        return self._by_context(*side("left_anti"), oov).unionByName(self._by_ranges(*side("left_semi")))

    @staticmethod
    def _by_context(rows: DataFrame, counts: DataFrame, oov: DataFrame) -> DataFrame:
        """pairs, of contexts that a task sorts: rows and counts of a context are dealt to it once, as whole numbers (alone: a word's unigram count), which
        give the places' order and the probabilities."""
        none = F.lit(None).cast("bigint")
        both = counts.select(*PAIR, "c", "alone", none.alias("place")).unionByName(rows.select(*PAIR, none.alias("c"), "alone", "place"))
        both = both.repartition("student", "prev").groupBy(*PAIR).agg(*(F.max(c).alias(c) for c in ("c", "alone", "place")))
        context, seen = Window.partitionBy("student", "prev"), F.col("c").isNotNull()
        by_place = context.orderBy(F.desc("alone"), "token").rowsBetween(Window.unboundedPreceding, 0)
        if_seen = F.sum(F.when(seen, F.col("alone"))).over(context)
        out = both.withColumns({"nth": F.row_number().over(context.orderBy(F.desc_nulls_last("c"), "token")), "before": F.count("c").over(by_place)})
        out = out.withColumns({"total": F.sum("c").over(context), "n": F.count("c").over(context), "alones": if_seen}).where("place is not null").join(F.broadcast(oov), "student")
        rank = F.when(seen, F.col("nth") - 1).otherwise(F.col("place") + F.col("n") - F.col("before"))
        own, mass = (F.col("alone") + 1) * F.col("oov_p"), (F.col("alones") + F.col("n")) * F.col("oov_p")
        p = F.when(seen, F.col("c") / (F.col("total") + 1)).when(F.col("n") > 0, own / ((F.col("total") + 1) * (1 - mass))).otherwise(own)
        return out.select(*PAIR, rank.cast("long").alias("rank"), p.alias("p"))

    def _by_ranges(self, asked: DataFrame, counts: DataFrame) -> DataFrame:
        """pairs, of contexts of any size."""
        asked, counts = asked.drop("alone"), counts.drop("alone")
        continuations = self._numbered(counts)
        seen = continuations.select(*PAIR, "c", "nth")
        contexts = counts.groupBy("student", "prev").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.sum("p").alias("mass"))
        rows = stored(asked.join(seen, PAIR, "left").join(contexts, ["student", "prev"], "left"), "asked-pairs")
        # seen words of the same context before an unseen one: its number among both, less its number among the unseen
        new = rows.where("nth is null and n is not null").select(*PAIR, "place")
        old = continuations.join(new.select("student", "prev").distinct(), ["student", "prev"], "left_semi").select(*PAIR, "place")
        order = [F.asc("place"), F.asc("new"), F.asc("token")]
        both = numbered(old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))), ["student", "prev"], order, "of_both")
        own = numbered(new.withColumn("new", F.lit(True)), ["student", "prev"], order, "of_new").select(*PAIR, "of_new")
        before = both.where("new").join(own, PAIR).select(*PAIR, (F.col("of_both") - F.col("of_new")).alias("before"))
        out = rows.join(before, PAIR, "left")
        rank = F.when(F.col("nth").isNotNull(), F.col("nth") - 1).otherwise(F.col("place") + F.coalesce(F.col("n") - F.col("before"), F.lit(0)))
        p = F.when(F.col("nth").isNotNull(), F.col("c") / (F.col("total") + 1)).when(F.col("n").isNotNull(), F.col("p") / ((F.col("total") + 1) * (1 - F.col("mass")))).otherwise(F.col("p"))
        return out.select(*PAIR, rank.cast("long").alias("rank"), p.alias("p"))

    def tokens(self, tokens: DataFrame) -> DataFrame:
        """A token table (traj_id, student, pos, start, end, rank, surprisal, and type if tokens have it); the first token of a text is never scored."""
        rows = (tokens if "prev" in tokens.columns else with_previous(tokens)).where("pos > 0").withColumns({"key": F.lower("token"), "prev": F.lower("prev")}).drop("token")
        asked = rows.select("prev", F.col("key").alias("token")).distinct()
        scored = self.pairs(asked).withColumnRenamed("token", "key")
        return rows.join(scored, ["prev", "key"]).select("traj_id", "student", "pos", "start", "end", "rank", (-F.ln("p")).alias("surprisal"), *(c for c in tokens.columns if c == "type"))
