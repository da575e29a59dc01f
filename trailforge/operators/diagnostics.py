"""Checks on the method itself: rank correlation, spread over seeds, students compared, boundaries shifted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def average_rank(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with a rank from 1 in which equal values share their mean rank."""
    nth = numbered(rows, by, [F.asc(value)], "__nth")
    means = nth.groupBy(*by, value).agg(F.avg("__nth").alias(name))
    left, right = nth.drop("__nth").alias("l"), means.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, value]]
    return left.join(right, reduce(Column.__and__, same)).select("l.*", f"r.{name}")


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns in each group; null where one of them is constant."""
    r = average_rank(average_rank(rows, by, x, "rx"), by, y, "ry")
    flat = (F.stddev_pop("rx") == 0) | (F.stddev_pop("ry") == 0)
    sums = r.groupBy(*by).agg(F.count("*").alias("n"), flat.alias("flat"), F.covar_pop("rx", "ry").alias("cov"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return sums.select(*by, "n", F.when(~F.col("flat"), F.try_divide("cov", F.col("sx") * F.col("sy"))).alias("rho"))


def gate_correlation(rows: DataFrame, least: float = 0.8) -> DataFrame:
    return rows.withColumn("holds", F.coalesce(F.col("rho") >= least, F.lit(False)))


def mean_std(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds; the deviation of one value is null."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def experiment_grid(conditions: DataFrame, students: DataFrame, seeds: DataFrame) -> DataFrame:
    return conditions.crossJoin(F.broadcast(students)).crossJoin(F.broadcast(seeds))


def student_divergence(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """(traj_id, rank_a, rank_b, shift) of two students' rankings (traj_id, student, rnk)."""
    side = lambda s, n: ranks.where(F.col("student") == s).select("traj_id", F.col("rnk").alias(n))
    return side(a, "rank_a").join(side(b, "rank_b"), "traj_id").withColumn("shift", F.abs(F.col("rank_a") - F.col("rank_b")))


def best_alpha(rows: DataFrame, metric: str) -> DataFrame:
    """The alpha with the best metric for each student; the smaller of equals."""
    return rows.groupBy("student").agg(F.max_by("alpha", F.struct(metric, -F.col("alpha"))).alias("alpha"), F.max(metric).alias(metric))


def subsets(rows: DataFrame, k: int, seed: int = 42, id_: str = "id") -> DataFrame:
    """k disjoint subsets by a hash of the id."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_))), 1, 7), 16, 10).cast("int") % k
    return rows.withColumn("subset", bucket)


def shift_boundaries(spans: DataFrame, tokens: DataFrame, by: int) -> DataFrame:
    """Spans (traj_id, spans) with both ends moved by a number of tokens: a start to that of the token so many
    places before its first token, an end to that of the token so many after its last (negative: inwards)."""
    one = spans.select("traj_id", F.posexplode("spans").alias("i", "s"))
    within = tokens.join(one, "traj_id").where((F.col("start") < F.col("s.e")) & (F.col("end") > F.col("s.s")))
    ends = within.groupBy("traj_id", "i").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    last = tokens.groupBy("traj_id").agg(F.max("pos").alias("most"))
    ends = ends.join(last, "traj_id").select("traj_id", "i", F.greatest(F.col("first") - by, F.lit(0)).alias("first"), F.least(F.col("last") + by, F.col("most")).alias("last")).where("first <= last")
    edge = lambda place, at: tokens.select("traj_id", F.col("pos").alias(place), F.col(at).alias(f"at_{place}"))
    moved = ends.join(edge("first", "start"), ["traj_id", "first"]).join(edge("last", "end"), ["traj_id", "last"])
    made = moved.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct(F.col("at_first").cast("int").alias("s"), F.col("at_last").cast("int").alias("e"), F.lit("search_decision").alias("label")))).alias("spans"))
    return spans.select("traj_id").join(made, "traj_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int,label:string>>")))


def rank_stability(before: DataFrame, after: DataFrame, score: str, digits: int = 6) -> DataFrame:
    """(student, n, rho): Spearman's correlation of a score's rankings before and after a change (finite scores in both)."""
    side = lambda rows, n: rows.select("traj_id", "student", F.round(score, digits).alias(n)).where(F.col(n) < float("inf"))
    return spearman(side(before, "x").join(side(after, "y"), ["traj_id", "student"]), ["student"], "x", "y")


def subset_correlation(scores: DataFrame, evaluated: DataFrame, k: int, score: str, metric: str = "em", seed: int = 42, digits: int = 6) -> DataFrame:
    """(student, n, rho): Spearman's correlation, over k subsets of the texts, of a subset's mean score and its mean metric.

    scores: traj_id, student, the score; evaluated: traj_id, student, the metric reached by training on the subset's texts.
    """
    rows = subsets(scores.where(F.col(score) < float("inf")).join(evaluated, ["traj_id", "student"]), k, seed, "traj_id")
    means = rows.groupBy("student", "subset").agg(F.round(F.avg(score), digits).alias("x"), F.round(F.avg(metric), digits).alias("y"))
    return spearman(means, ["student"], "x", "y")
