"""The corpus pipeline: language ID, exact dedup, near-dedup, substring dedup and packing over documents.

Stages tell rows apart by doc_id and text, either of which may be null: of two texts under one doc_id
each has its own verdict, rows that repeat both share it, and a null or empty text is rejected by the
first stage. Extra columns pass through, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cullspark.llm import exact_dedup, langid, minhash, packing, queries, substring_dedup
from cullspark.llm.common import cut, drop_rows, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages, by the pages that show them too; rejected ones go."""
    small_batches(spark)
    return drop_rows(docs, langid.documents_identified(spark, docs, queries.pages_beside(spark, sf_dir)).where("not kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest doc_id of each group of equal texts."""
    small_batches(spark)
    return drop_rows(docs, exact_dedup.exact_groups(docs).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near-duplicates."""
    small_batches(spark)
    return drop_rows(docs, minhash.near_classes(docs).where("not kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text."""
    small_batches(spark)
    done = substring_dedup.without_repeats(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.packed(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substrings), ("packing", pack)]
#: Models, signatures and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
