"""Sources and sinks: JSON Lines, TSV, Parquet, JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tsv_safe
from ..operators import corpus
from ..operators.ordering import numbered
from ..session import stored
from . import schemas

REGISTRY = {
    "hotpotqa": {"schema": schemas.HOTPOTQA, "extract": corpus.from_hotpotqa, "splits": ("train", "validation")},
    "musique": {"schema": schemas.MUSIQUE, "extract": corpus.from_musique, "splits": ("train", "validation")},
    "2wikimultihopqa": {"schema": schemas.TWOWIKI, "extract": corpus.from_2wiki, "splits": ("train", "validation")},
}


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of JSON Lines files with an explicit schema and pos; a missing or zero limit means all.

    strict stops at a line that isn't JSON (else its columns are null).
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    rows = with_pos(rows)
    return rows.orderBy("pos").limit(limit) if limit else rows


def with_pos(rows: DataFrame, file_pattern: str | None = None) -> DataFrame:
    """An increasing position, from 0: by file name, and in a file by place. rows are a read of files, or a table without any.

    With a pattern, a column file has what its first group finds in a row's file name.

    A file's rows come in the order of the partitions that read it, so counts by partition and file give each its place.
    """
    if not rows.inputFiles():
        rows = rows.withColumn("pos", F.monotonically_increasing_id())
        return rows if file_pattern is None else rows.withColumn("file", F.lit(None).cast("string"))
    meta = rows.metadataColumn("_metadata")
    read = rows.select("*", meta["file_path"].alias("__file"), meta["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = read.groupBy("__file", "__block").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block")) - F.col("__n")  # a row for each block of a file
    blocks = blocks.select("__file", "__block", (before - F.col("__low")).alias("__shift"))
    placed = read.join(blocks, ["__file", "__block"]).withColumn("pos", F.col("__at") + F.col("__shift"))
    placed = placed if file_pattern is None else placed.withColumn("file", F.regexp_extract("__file", file_pattern, 1))
    return placed.drop("__file", "__block", "__at", "__shift")


def read_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with pos, damaged lines: pos, file, line) of JSON Lines files, read once.

    A damaged line isn't JSON, or has a value that its column can't hold; its place counts in pos.
    """
    rows = spark.read.schema(f"{schema}, _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").json(path)
    rows = stored(with_pos(rows, r"([^/]+)$"), "checked")
    return rows.where("_damaged is null").drop("_damaged", "file"), rows.where("_damaged is not null").select("pos", "file", F.col("_damaged").alias("line"))


def load_questions(spark: SparkSession, path: str, max_questions: int | None = None) -> DataFrame:
    """(pos, id, question, answer); the answer defaults to an empty text. A limit of 0 gives one row, as the format's reader does."""
    rows = read_jsonl(spark, path, "id string, question string, answer string", None if max_questions is None else max(1, max_questions))
    return rows.select("pos", "id", "question", F.coalesce("answer", F.lit("")).alias("answer"))


def _found(spark: SparkSession, path: str) -> list:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return list(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or [])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_found(spark, path))


def stream_path(spark: SparkSession, path: str) -> str:
    """A path as a file stream takes it: a stream of a lone file needs a pattern."""
    found = _found(spark, path)
    return f"{path[:-1]}[{path[-1]}]" if len(found) == 1 and found[0].isFile() and not set(path) & set("*?[{") else path


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A best-effort source: empty, with the schema, if there is no such file."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else with_pos(spark.createDataFrame([], schema))


def read_glob(spark: SparkSession, folder: str, schema: str, pattern: str = "*_train.jsonl") -> DataFrame:
    """All files of a folder (or folders of part files) that match, with the stem of their name; an error if there are none."""
    if not exists(spark, f"{folder}/{pattern}"):
        raise FileNotFoundError(f"{folder}/{pattern}")
    return with_pos(spark.read.schema(schema).json(f"{folder}/{pattern}"), r"([^/]+)\.jsonl(?:/[^/]+)?$")


def convert_dataset(spark: SparkSession, name: str, paths: dict[str, str], max_samples: int | None = None) -> DataFrame:
    """All splits of a registered dataset in the common schema; a split whose file is missing is left out."""
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset {name!r}; there are {sorted(REGISTRY)}")
    entry, parts = REGISTRY[name], []
    for split in entry["splits"]:
        if split in paths and exists(spark, paths[split]):
            raw = read_jsonl(spark, paths[split], entry["schema"], max_samples)
            parts.append(corpus.tagged(entry["extract"](raw), name, split))
    out = spark.createDataFrame([], schemas.QA)
    for part in parts:
        out = out.unionByName(part)
    return out


def availability(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(dataset, status, reason) of expected files: a missing one is skipped with a reason."""
    rows = [(n, "ok", None) if exists(spark, p) else (n, "skipped", f"missing file {p}") for n, p in files.items()]
    return spark.createDataFrame(rows, "dataset string, status string, reason string")


def named(rows: DataFrame, names: str, column: str = "dataset") -> DataFrame:
    """Rows of the datasets in a list separated by commas; an error if there are none of any of its names."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if not wanted or rows.where(F.col(column).isin(wanted)).isEmpty():
        raise ValueError(f"no dataset of {names!r}")
    return rows.where(F.col(column).isin(wanted))


def write_jsonl(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_counted(rows: DataFrame, path: str, counts: dict[str, Column], partition_by: list[str] | None = None, mode: str = "errorifexists") -> dict:
    """Write JSON Lines; returns aggregates of the rows, taken from the write itself."""
    seen = Observation()
    write_jsonl(rows.observe(seen, *(c.alias(n) for n, c in counts.items())), path, partition_by, mode)
    return seen.get


def write_partitions(rows: DataFrame, path: str, by: list[str], files: int = 1) -> None:
    """Write JSON Lines into partitions of some columns, replacing those that rows have and no others; each has up to ``files`` files,
    which their rows are dealt to by a hash. Large ones are spread over more tasks, and files, by Spark's rebalancing, so that none is brought to one task."""
    part = [F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(files)).alias("__file")] if files > 1 else []
    dealt = rows.select("*", *part).hint("rebalance", *by, *(["__file"] if part else [])).drop("__file")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def collection_rows(passages: DataFrame) -> DataFrame:
    """(i, text) of a dense engine's collection: i numbers passages from 0 by pos."""
    places = numbered(passages.select("pos"), [], [F.asc("pos")], "i").withColumn("i", F.col("i") - 1)
    return passages.join(places, "pos").select("i", tsv_safe(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path)


def write_report(rows: DataFrame, path: str, key: str) -> dict:
    """A small aggregate as one JSON object by key, on the driver; returns it."""
    report = {r[key]: {c: r[c] for c in rows.columns if c != key} for r in rows.collect()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)
    return report
