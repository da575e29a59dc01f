"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; what it returns is written as Parquet and read again for the next one. All
but the last return the columns of documents.

Defined results, beyond those of the operators: an empty documents table passes every stage and
gives no rows; extra columns are carried as they are, whatever their names; very long texts are
read whole in every stage; a null or empty text fails the base rule of the first stage, so later
stages of run() meet one only where suffix-array dedup leaves nothing of a text (it is packed as
the end id alone); of repeated rows (one identifier and text) one stays; ties go to the
smallest identifier, then to a hash of the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, owner, scratch, tables
from .minhash import drop_near_duplicates
from .mixing import mixed
from .packing import pack_documents
from .quality import quality_filter
from .suffixes import without_repeats
from .tokens import public_path

#: Scratch tables of stages that are called by themselves: those of one go when the next begins (its docs are stored).
_alone = Scratch()


def _stage(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    if owner() is not None:
        return work()
    _alone.release(spark)
    with _alone:
        return work()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the base rule or the risk-controlled cutoff rejects go.

    A null language is a stratum of its own; without labels only the base rule decides.
    """
    return _stage(spark, lambda: quality_filter(docs, tables(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group at similarity 0.8 on five-word shingles one document stays, that with the smallest
    identifier. Texts without words stay; documents without an identifier stay unless their group has one with."""
    return _stage(spark, lambda: drop_near_duplicates(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: strings of 200 bytes that occur elsewhere are cut out of the texts; no row goes."""
    return _stage(spark, lambda: without_repeats(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: all documents, in the order of the mix of their sources (null is a source of its own)."""
    return _stage(spark, lambda: mixed(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a row for each piece in sequences of at most 4096 tokens, numbered in the order of the stored mix.

    A null or empty text is the end id alone.
    """
    return _stage(spark, lambda: pack_documents(docs, public_path("word_bpe_49k.json"), 2, split="white_space", stored_order=True))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: The stages aren't SQL (Python features, models, suffix arrays); tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = tables(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        own = Scratch()
        with own:
            docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := scratch(spark, f"stage-{name}"))
            own.release(spark)
            docs = spark.read.parquet(path)
        elif (outer := owner()) is not None:  # the result is lazy: its tables go with the caller's
            outer.paths += own.paths
    return docs
