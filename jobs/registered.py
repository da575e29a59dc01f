"""The jobs as queries: each runs twice into one new folder, and returns the whole output as it stands after that; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import corpus, transcripts
from trailforge.plans.sql import LINES, SPANS, extract
from trailforge.session import new_folder


def job1_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1-corpus")
    for _ in range(2):
        out = corpus.run(spark, f"{sf_dir}/documents.parquet", folder, corpus.Settings())
    return out


def job2_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2-transcripts")
    for _ in range(2):
        out = transcripts.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out", f"{folder}/checkpoint", transcripts.Settings())
    out = out.withColumns({"queries": F.array_join("queries", "|"), "spans": F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"], x["e"])), "|"), "span_share": F.round("span_share", 6)})
    return out.withColumn("num_search_steps", F.col("num_search_steps").cast("long"))


QUERIES = {"job1_corpus": job1_corpus, "job2_transcripts": job2_transcripts}
SQL = {
    "job1_corpus": f"WITH {LINES.replace('{filter}', '')} SELECT title || '_' || nth AS id, title, text, nth, substr(md5(title), 1, 1) AS shard FROM corpus",
    "job2_transcripts": f"""WITH {SPANS}, found AS (SELECT id, string_agg(s || '-' || e, '|' ORDER BY s, e) AS spans, sum(e - s) AS n FROM spans GROUP BY id)
SELECT t.id, question_id, dataset, text, num_search_steps, array_to_string(queries, '|') AS queries, incomplete, {extract('text')} AS answer, NOT incomplete AND num_search_steps > 0 AS valid,
  coalesce(f.spans, '') AS spans, round(coalesce(f.n, 0)::DOUBLE / length(text), 6) AS span_share, pos // 1000 AS part
FROM traj t LEFT JOIN found f ON f.id = t.id""",
}
