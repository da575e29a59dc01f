"""Scores of predictions against gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_match, extract_answer, token_f1


def evaluate(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows (id, question, gold, prediction, prediction_full, em, f1, missing): every gold (id, question, answer) with its prediction (id, text).

    A question without a prediction counts as answered with an empty text, and is marked as missing.
    """
    rows = gold.join(predictions.select("id", F.col("text").alias("prediction_full"), F.lit(False).alias("missing")), "id", "left")
    rows = rows.withColumns({"prediction_full": F.coalesce("prediction_full", F.lit("")), "missing": F.coalesce("missing", F.lit(True))})
    rows = rows.withColumn("prediction", extract_answer("prediction_full"))
    return rows.select("id", "question", F.col("answer").alias("gold"), "prediction", "prediction_full", exact_match("prediction", "answer").alias("em"), token_f1("prediction", "answer").alias("f1"), "missing")


def summarize(rows: DataFrame, by: str = "name") -> DataFrame:
    """Mean em and f1, the number of rows, and of those without a prediction; 0 where there are none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return rows.groupBy(by).agg(mean("em"), mean("f1"), F.count("*").alias("n"), F.count_if("missing").alias("missing"))
