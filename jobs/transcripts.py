"""Incremental job: files of conversation turns to annotated search transcripts; each run takes only the files that are new.

    python -m jobs.transcripts --conversations IN --output OUT --checkpoint CP [--config jobs/transcripts.json]

A file stream takes what came since the last run and stops (its checkpoint knows the files). A batch is written to OUT/turns by part
(a range of conversations) and batch number; then the transcripts of the parts it touches are made again from all their turns and replace
those partitions of OUT/transcripts. Turns of one conversation may so come in several files and in any order. A batch that is run again after a
crash has the same number and writes the same partitions, so it adds nothing. OUT/batches has one row of counts for each batch, taken from
the write itself.

Turns without a conversation or a number are left out and counted. Of several rows of one turn that of the last batch counts, of equal ones
one, else the greatest. A part should be small beside a batch where files bring new conversations, as its transcripts are written anew.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __package__ in (None, ""):  # run as a file
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from trailforge.operators import trajectories
from trailforge.sources.jsonl import stream_path
from trailforge.streaming.transcripts import annotate

TURNS = "conv_id long, turn long, role string, text string"
STORED = f"{TURNS}, part long, batch long"
TRANSCRIPTS = "id string, question_id string, dataset string, text string, num_search_steps int, queries array<string>, incomplete boolean, answer string, valid boolean, spans array<struct<s:int,e:int,label:string>>, span_share double, part long"
BATCHES = "turns long, left_out long, parts long, transcripts long, valid long, batch long"
log = logging.getLogger("jobs.transcripts")


@dataclass(frozen=True)
class Settings:
    format: str = "parquet"
    conversations_a_part: int = 1000
    files_a_batch: int = 1000
    extended_spans: bool = False


def overwrite(rows: DataFrame, path: str, by: list[str], within: tuple[str, ...], **counts: Column) -> dict:
    """Replace the partitions that rows have, and no others; rows of a partition in order. Returns counts of what was written."""
    wrote = Observation()
    # observed behind the ranges, whose bounds come from a run of what is before them
    dealt = rows.repartitionByRange(*by, *within).sortWithinPartitions(*by, *within).observe(wrote, *(c.alias(n) for n, c in counts.items()))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return wrote.get


def transcripts_of(turns: DataFrame, config: Settings) -> DataFrame:
    """Annotated transcripts of all turns (with their batch)."""
    last = turns.groupBy("conv_id", "turn").agg(F.max(F.struct("batch", "role", "text")).alias("t")).select("conv_id", "turn", "t.role", "t.text")
    rows = annotate(trajectories.from_conversations(last), config.extended_spans)
    return rows.withColumn("part", F.expr(f"pos div {config.conversations_a_part}")).select(*(c.split()[0] for c in TRANSCRIPTS.split(", ")))


def take(batch: DataFrame, number: int, output: str, config: Settings) -> int:
    """One batch of new turns; returns how many rows came."""
    spark = batch.sparkSession
    usable = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = batch.where(usable).withColumns({"part": F.expr(f"conv_id div {config.conversations_a_part}"), "batch": F.lit(number).cast("long")})
    counts = overwrite(rows, f"{output}/turns", ["part", "batch"], ("conv_id", "turn"), turns=F.count(F.lit(1)))
    counts["left_out"] = batch.where(~usable).count()

    turns = spark.read.schema(STORED).parquet(f"{output}/turns")
    parts = [r.part for r in turns.where(F.col("batch") == number).select("part").distinct().collect()]  # folder names
    touched = turns.where(F.col("part").isin(parts) & (F.col("batch") <= number))
    counts |= overwrite(transcripts_of(touched, config), f"{output}/transcripts", ["part"], ("id",), transcripts=F.count(F.lit(1)), valid=F.count_if("valid"))
    counts |= {"parts": len(parts), "batch": number}
    overwrite(spark.createDataFrame([counts], BATCHES), f"{output}/batches", ["batch"], (), n=F.count(F.lit(1)))
    log.info("batch %d: %s", number, counts)
    return counts["turns"] + counts["left_out"]


def run(spark: SparkSession, conversations: str, output: str, checkpoint: str, config: Settings) -> DataFrame:
    """Take what is new and wait for it; returns all transcripts as they then stand."""
    for name, schema, by in (("turns", STORED, ["part", "batch"]), ("transcripts", TRANSCRIPTS, ["part"]), ("batches", BATCHES, ["batch"])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{output}/{name}")  # nothing may have come yet
    new = spark.readStream.format(config.format).schema(TURNS).option("maxFilesPerTrigger", config.files_a_batch).load(stream_path(spark, conversations))
    came: list[int] = []
    query = new.writeStream.foreachBatch(lambda batch, number: came.append(take(batch, number, output, config))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %d new rows of %s; %s/transcripts is up to date", sum(came), conversations, output)
    return spark.read.schema(TRANSCRIPTS).parquet(f"{output}/transcripts")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("conversations", "output", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    a = args.parse_args()
    spark = settings.start("transcripts")
    try:
        run(spark, a.conversations, a.output, a.checkpoint, settings.load(Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
