"""Row numbers that don't bring a whole group to one task, and small inputs dealt out evenly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of one group that a task may sort alone.
MOST_IN_TASK = 1 << 20


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows, dealt out evenly if they come in fewer partitions than the session has cores (for costly work on each row); by columns, if
    given, so that grouping by them needs no other exchange."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *by) if rows.rdd.getNumPartitions() < cores else rows


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with a number from 1 in the given order within each group; order should tell all rows of a group apart.

    Groups of up to MOST_IN_TASK rows are numbered by a window. Beyond that rows are dealt by ranges of the groups and the
    order, counted for each range and group, and numbered from there: no task holds more than a range. The rows are stored
    in the shared folder so that they are made once.
    """
    rows = stored(rows, "numbered")
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= MOST_IN_TASK:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    dealt = rows.repartitionByRange(*(F.col(c) for c in by), *order).sortWithinPartitions(*(F.col(c) for c in by), *order)
    dealt = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(*by, part.alias("__part")).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    counts = counts.select(*by, "__part", (before - F.col("__low") + 1).alias("__shift"))
    left, right = dealt.withColumn("__part", part).alias("l"), counts.alias("r")
    same = reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__part"]))
    return left.join(right, same).select(*(F.col(f"l.{c}") for c in rows.columns), (F.col("l.__at") + F.col("r.__shift")).alias(name))
