"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Each stage is judged on what its predecessor kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import apportion, bottom_k, multi_instance, prefix_join, super_kmers
from tidemark.llm.tables import fresh, without
from tidemark.sources.staging import leave_with_session, shared_dir

TOXIC = 0.3
SHINGLE_WORDS = 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit, by a model of all their labels."""
    model = multi_instance.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_score")
    return multi_instance.with_scores(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component; documents without words, and null ids, stay."""
    found = bottom_k.similar_components(docs, shingle_words=SHINGLE_WORDS)
    return without(docs, "doc_id", found.where("NOT kept").select("doc_id"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a smaller id has; one of which no word is left goes, one that had none stays."""
    size, lost = fresh(docs, "_words"), fresh(docs, "_lost")
    cut = super_kmers.remove_repeats(docs, size_col=size, lost_col=lost, as_is=True)
    cut = cut.where((F.col(lost) < F.col(size)) | (F.col(size) == 0))
    return cut.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def reject_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = prefix_join.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, "doc_id", found.where("contaminated").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return apportion.mix_to_targets(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("decontamination", reject_benchmark_leaks),
    ("mix", mix_sources),
]

#: Toxicity is learned by gradient steps, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    leave_with_session(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
