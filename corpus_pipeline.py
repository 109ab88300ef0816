"""The corpus pipeline: classifier, quality rules, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir); ``docs`` is a Parquet table with the columns of
``documents`` that the stage before left. ``run`` applies them in order, each result written to
the shared folder and read again. Texts go to Python in small batches, so that executors need not hold
whole splits of them (see ``common.small_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import bpe, classifier, mixing, near_copies, quality_rules
from palisade.llm.common import documents, small_batches, written
from palisade.llm.queries import tokenizer_path


def keep_good_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    small_batches(spark)
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    small_batches(spark)
    order, _ = quality_rules.plan_cascade(docs)
    return quality_rules.keep_good(docs, order)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard index of 0.8 or more of five-word shingles; SimHash finds the closest, MinHash the rest."""
    small_batches(spark)
    return near_copies.drop_near_copies(docs, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    small_batches(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(spark)
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_good_scores),
    ("quality_rules", keep_good_by_rules),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The stages learn a model, link by hashes and encode with a vocabulary: no SQL for their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
