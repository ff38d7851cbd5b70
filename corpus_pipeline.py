"""A corpus pipeline of five stages over the documents table.

Quality rules drop documents, line dedup drops lines that many documents share, the n-gram Jaccard join keeps one
document of each group of near copies, mixing replicates documents to the sources' target weights, and packing turns
texts into token sequences. Each stage works on all that the one before it kept; all but the last return the columns of
documents.

SQL can't express the learned rules, the tokenizer or the packing, so there is no SQL for run(); tests hold it against
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from citeweave.llm._common import keep_only, stored, written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules learned from `labels` keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that at least three of them share, but for the one with the largest doc_id."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, replicated to shares by the square root of a source's characters, in a global shuffle."""
    mass = F.coalesce(F.char_length("text"), F.lit(0))
    return mixing.mix_sources(docs, mass=mass, power=0.5, epochs=1.0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        mark = written()
        docs = keep_only(stored(stage(spark, docs, sf_dir)), mark)  # what the stage left behind goes
    return STAGES[-1][1](spark, docs, sf_dir)
