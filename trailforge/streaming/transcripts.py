"""Transcripts as a stream of JSON Lines files: annotated and appended as they arrive, and counted with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spans import char_share, decision_spans
from ..functions.text import extract_answer
from ..operators.trajectories import generation_summary, valid
from ..sources.schemas import TRAJECTORIES


def read_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(TRAJECTORIES).option("maxFilesPerTrigger", files_a_batch).json(folder)


def annotate(rows: DataFrame, extended: bool = False) -> DataFrame:
    """Spans, their share of the text, the answer, and whether the transcript is valid."""
    rows = rows.withColumn("spans", decision_spans("text", extended=extended))
    return rows.withColumns({"span_share": char_share(F.col("spans"), F.col("text")), "answer": extract_answer("text"), "valid": valid()})


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; a restart goes on where the last one ended."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """One batch as a partition of its number; written again, it replaces itself."""
    rows = batch.withColumn("batch", F.lit(number).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def append_once(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """As append, but by numbered batches, for sinks that a crash may leave half written: a batch that runs again adds nothing."""
    return rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summarize(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep generation_summary of all transcripts that have come, by dataset, as a table that each batch replaces; the counts are the stream's state."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return generation_summary(rows).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
