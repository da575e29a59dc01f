"""Question records of several datasets in one schema, and the passage corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

FACTS = "array<struct<title:string,sent_id:int,paragraph_text:string>>"
QA = ["id", "question", "answer", "supporting_facts", "dataset", "split"]


def zip_facts(titles: Column, sents: Column) -> Column:
    """Pairs of two arrays, as many as the shorter has."""
    n = F.coalesce(F.least(F.size(titles), F.size(sents)), F.lit(0))
    n = F.greatest(n, F.lit(0))
    fact = lambda t, s: F.struct(t.alias("title"), s.cast("int").alias("sent_id"), F.lit(None).cast("string").alias("paragraph_text"))
    return F.coalesce(F.zip_with(F.slice(titles, 1, n), F.slice(sents, 1, n), fact), F.array().cast(FACTS))


def from_hotpotqa(raw: DataFrame) -> DataFrame:
    return raw.select("id", "question", "answer", zip_facts(F.col("supporting_facts.title"), F.col("supporting_facts.sent_id")).alias("supporting_facts"))


def from_musique(raw: DataFrame) -> DataFrame:
    used = F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(False)))
    fact = lambda p: F.struct(F.coalesce(p["title"], F.lit("")).alias("title"), F.lit(None).cast("int").alias("sent_id"), F.coalesce(p["paragraph_text"], F.lit("")).alias("paragraph_text"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return raw.select(text("id"), "question", text("answer"), F.coalesce(F.transform(used, fact), F.array().cast(FACTS)).alias("supporting_facts"))


def from_2wiki(raw: DataFrame) -> DataFrame:
    """supporting_facts is raw JSON: an object of two arrays, or a list of [title, sentence] pairs (shorter ones are left out)."""
    raw_facts = F.col("supporting_facts")
    columns = F.from_json(raw_facts, "struct<title:array<string>,sent_id:array<int>>")
    pairs = F.filter(F.from_json(raw_facts, "array<array<string>>"), lambda p: F.size(p) >= 2)
    fact = lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("sent_id"), F.lit(None).cast("string").alias("paragraph_text"))
    facts = F.when(F.ltrim(raw_facts).startswith("{"), zip_facts(columns["title"], columns["sent_id"])).otherwise(F.coalesce(F.transform(pairs, fact), F.array().cast(FACTS)))
    return raw.select(F.coalesce("_id", "id", F.lit("")).alias("id"), "question", "answer", F.coalesce(facts, F.array().cast(FACTS)).alias("supporting_facts"))


def tagged(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    return rows.withColumns({"dataset": F.lit(dataset), "split": F.lit(split)}).select(*QA)


def split_counts(qa: DataFrame) -> DataFrame:
    """Rows of each dataset and split, of each dataset, and of all."""
    return qa.rollup("dataset", "split").agg(F.count("*").alias("n"))


def distinct_titles(qa: DataFrame) -> DataFrame:
    return qa.select(F.explode("supporting_facts.title").alias("title")).distinct()


def context_passages(raw: DataFrame) -> DataFrame:
    """(title, text, pos) of column-wise contexts: a passage is its sentences joined by spaces."""
    n = F.least(F.size("context.title"), F.size("context.sentences"))
    pairs = F.zip_with(F.slice("context.title", 1, n), F.slice("context.sentences", 1, n), lambda t, s: F.struct(t.alias("title"), F.array_join(s, " ").alias("text")))
    return raw.select("pos", F.posexplode(pairs).alias("i", "p")).select("p.title", "p.text", F.struct("pos", "i").alias("pos"))


def build_corpus(passages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(id, title, text) from (title, text, pos): empty and repeated texts of a title go, the first stays;
    numbered within the title in order of first appearance. titles, if given, are the only ones kept."""
    rows = passages.where(F.col("text") != "")
    if titles is not None:
        rows = rows.join(titles.select("title"), "title", "left_semi")
    # texts are told apart and numbered by digests and places; they are shuffled once, to meet their numbers
    digests = rows.select("title", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("hash"), "pos")
    first = digests.groupBy("title", "digest").agg(F.min("pos").alias("pos"), F.min("hash").alias("hash")).drop("digest")
    nth = numbered(first, ["title"], [F.asc("pos"), F.asc("hash")], "nth")
    at = F.struct("title", "pos").alias("at")  # never null itself, so that rows without a title meet too
    left, right = rows.select(at, "text").alias("l"), nth.select(at, "hash", (F.col("nth") - 1).alias("nth")).alias("r")
    # a place may come again with another text (told apart by the hash) or with the same one (one is kept)
    met = left.join(right, (F.col("l.at") == F.col("r.at")) & (F.xxhash64("l.text") == F.col("r.hash"))).select("r.at", "r.hash", "text", "nth")
    one = met.groupBy("at", "hash").agg(F.first("nth").alias("nth"), F.first("text").alias("text"))  # by the keys of the join: no other shuffle or sort
    return one.select(F.concat_ws("_", "at.title", "nth").alias("id"), "at.title", "text", "nth")


def in_title_order(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy("title", "nth")
