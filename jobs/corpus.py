"""Batch job: documents to a passage corpus in shards, for retrieval.

    python -m jobs.corpus --documents IN --output OUT [--titles TABLE] [--shards 0 a f] [--config jobs/corpus.json]

A document is cut into passages at its separator; empty passages and those that repeat under a title go, the first stays, and
passages are numbered within their title by first appearance. With a table of titles (column ``title``) only those are kept.

OUT/passages has id, title, text, nth by shard; OUT/titles has the counts of each title by shard. A title's shard is the first hex digits of
its md5, so all of a title is in one shard, in title order; a long one is spread over several files. Running it again gives the same rows: a full
run replaces the tables; a run for some shards reads only their titles and replaces those partitions and no others.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __package__ in (None, ""):  # run as a file
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from trailforge.operators import corpus

PASSAGES = "id string, title string, text string, nth long, shard string"
log = logging.getLogger("jobs.corpus")


@dataclass(frozen=True)
class Settings:
    format: str = "parquet"
    id: str = "doc_id"
    title: str = "source"
    text: str = "text"
    separator: str = "\n"
    shard_digits: int = 1
    most_rows_a_file: int = 1_000_000


def shard(title: str, digits: int):
    return F.substring(F.md5(F.col(title)), 1, digits)


def write(rows: DataFrame, path: str, by: list[str], some: bool, most: int) -> int:
    """rows by shard, in the order of by; some: only the partitions that rows have are replaced. Returns their number."""
    wrote, how = Observation(), "dynamic" if some else "static"
    # observed behind the ranges, whose bounds come from a run of what is before them
    dealt = rows.repartitionByRange("shard", *by).sortWithinPartitions("shard", *by).observe(wrote, F.count(F.lit(1)).alias("rows"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", how).option("maxRecordsPerFile", most).partitionBy("shard").parquet(path)
    return wrote.get["rows"]


def run(spark: SparkSession, documents: str, output: str, config: Settings, titles: str | None = None, shards: list[str] | None = None) -> DataFrame:
    """Write the tables; returns the whole corpus as it then stands."""
    read, cut = Observation(), Observation()
    docs = spark.read.format(config.format).load(documents).select(F.col(config.id).alias("doc"), F.col(config.title).cast("string").alias("title"), F.col(config.text).alias("text"))
    if shards is not None:
        docs = docs.where(shard("title", config.shard_digits).isin(shards))
    docs = docs.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull()).alias("without_text"))
    parts = docs.select("title", "doc", F.posexplode(F.split("text", f"\\Q{config.separator}\\E", -1)).alias("i", "text"))
    lines = parts.select("title", "text", F.struct("doc", "i").alias("pos")).observe(cut, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text") == "").alias("empty"))
    only = None if titles is None else spark.read.format(config.format).load(titles).select("title").distinct()
    rows = corpus.build_corpus(lines, only).withColumn("shard", shard("title", config.shard_digits))
    kept = write(rows, f"{output}/passages", ["title", "nth"], shards is not None, config.most_rows_a_file)
    log.info("read %s: %s", documents, read.get)
    log.info("cut: %s; wrote %d rows to %s/passages%s", cut.get, kept, output, "" if shards is None else f", shards {shards}")

    out = spark.read.schema(PASSAGES).parquet(f"{output}/passages")
    changed = out if shards is None else out.where(F.col("shard").isin(shards))
    counts = changed.groupBy("shard", "title").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))
    n = write(counts, f"{output}/titles", ["title"], shards is not None, config.most_rows_a_file)
    log.info("wrote %d rows to %s/titles", n, output)
    return out


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--documents", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--titles")
    args.add_argument("--shards", nargs="+")
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    a = args.parse_args()
    spark = settings.start("corpus")
    try:
        run(spark, a.documents, a.output, settings.load(Settings, a.config), a.titles, a.shards)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
