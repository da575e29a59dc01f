"""Session helper: settings every query of the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "trailforge", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session; ``conf`` overrides the defaults above.

    ANSI mode is left on: expressions guard divisions and lookups themselves.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is missing (tests, local mode) a folder is made.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="trailforge-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/trailforge/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """rows, written to a new shared folder and read back: made once, and not lost with an executor. options are the writer's."""
    path = new_folder(rows.sparkSession, name)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
