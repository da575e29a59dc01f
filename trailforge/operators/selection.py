"""Selection of transcripts: random, correct, structural with diversity, by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import select_top_k


def order_key(seed: int, id_: str = "id") -> Column:
    """A fixed pseudo-random order: does not depend on partitions or engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_)))


def random_selection(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(order_key(seed), "id").limit(k)


def correctness_selection(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The correct ones: all of them if there are no more than k (in order of pos), else k at random."""
    right = rows.where(F.coalesce("answer_correct", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order_key(seed), "id"))
    picked = right.select("id", "pos").orderBy(order_key(seed), "id").limit(k).withColumn("nth", nth)
    all_fit = right.limit(k + 1).agg((F.count("*") <= k).alias("all_fit"))
    return right.join(picked.select("id", "nth"), "id").crossJoin(F.broadcast(all_fit)).orderBy(F.when(F.col("all_fit"), F.col("pos")).otherwise(F.col("nth"))).drop("nth", "all_fit")


def structural_score(rows: DataFrame) -> DataFrame:
    """Depth, query diversity, evidence coverage and refinement, weighted; missing features count as none."""
    steps = F.coalesce("num_search_steps", F.lit(0))
    unique = F.coalesce("num_unique_queries", F.lit(0))
    total = F.coalesce("num_queries", F.greatest(F.lit(1), unique))
    diversity = F.when(total > 0, unique / total).otherwise(0.0)
    score = 0.25 * F.least(steps / 5, F.lit(1.0)) + 0.25 * diversity + 0.30 * F.coalesce("evidence_coverage", F.lit(0.0)) + 0.20 * F.coalesce("has_query_refinement", F.lit(False)).cast("int")
    return rows.withColumn("score", F.round(score, 6))


def topocurate_selection(rows: DataFrame, k: int, diversity_weight: float = 0.3) -> DataFrame:
    """The k best by structural score; with a weight, the first of each dataset is lifted by it.

    Greedy maximal marginal relevance with a bonus for unseen datasets has this
    closed form for weights in [0, 1]: a dataset's best row always comes before its others.
    It only works on a shortage: where all rows fit, they come in plain order of score.
    """
    if not 0 <= diversity_weight <= 1:
        raise ValueError("diversity_weight must be in [0, 1]")
    scored = structural_score(rows)
    if diversity_weight == 0:
        return scored.orderBy(F.desc("score"), "pos").limit(k).withColumn("key", F.col("score"))
    firsts = scored.groupBy("dataset").agg(F.max_by("pos", F.struct(F.col("score"), -F.col("pos"))).alias("__first"))
    scored = scored.alias("l").join(firsts.alias("r"), F.col("l.dataset").eqNullSafe(F.col("r.dataset"))).select("l.*", "r.__first")
    first = F.col("pos") == F.col("__first")
    bonus = (1 - diversity_weight) * F.col("score") + diversity_weight * first.cast("int")
    more = scored.limit(k + 1).agg((F.count("*") > k).alias("more"))
    keyed = scored.withColumn("bonus", F.round(bonus, 6)).crossJoin(F.broadcast(more)).withColumn("key", F.when(F.col("more"), F.col("bonus")).otherwise(F.col("score")))
    return keyed.orderBy(F.desc("key"), F.desc("score"), "pos").limit(k).drop("bonus", "more", "__first")


METHODS = {
    "random": "random",
    "correctness": "correct",
    "correctness_only": "correct",
    "topocurate": "structure",
    "topocurate_style": "structure",
    "rsr": "rsr_full",
    "vanilla_rsr": "rsr_full",
    "sd_rsr": "sd_rsr_score",
}


def select(method: str, rows: DataFrame, k: int = 500, seed: int = 42, scores: DataFrame | None = None, diversity_weight: float = 0.3) -> DataFrame:
    """Selection by the name of a method or condition; the score methods take a student's scores (traj_id, ..)."""
    kind = METHODS.get(method)
    if kind is None:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    if kind == "random":
        return random_selection(rows, k, seed)
    if kind == "correct":
        return correctness_selection(rows, k, seed)
    if kind == "structure":
        return topocurate_selection(rows, k, diversity_weight)
    if scores is None:
        raise ValueError(f"{method} needs scores")
    best = select_top_k(scores, kind, k).select(F.col("traj_id").alias("id"), F.col(kind).alias("score"))
    return rows.join(best, "id").orderBy(F.asc_nulls_last("score"), "id")
