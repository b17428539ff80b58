"""A training corpus from raw documents: five stages, each by one operator of veriframe.llm.

Every stage takes and gives whole tables; all but the last give rows with the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import byte_bpe, jaccard_join, language_id, packing, quality_rules, substring_dedup
from veriframe.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the labelled languages go."""
    return language_id.keep_known(docs, language_id.fit(language_id.sample(docs, sample_docs=300)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents stay in one of them."""
    cut = substring_dedup.cut_repeats(docs, min_words=50)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens: a row for each piece of a document with its place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), byte_bpe.PIECES, capacity=2048, end_id=0)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
