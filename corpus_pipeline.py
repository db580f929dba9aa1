"""Corpus cleaning in five stages, each over all rows that the stage before it kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> personal data -> mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.jaccard import drop_near_copies
from tracemill.llm.mixing import emit_copies, mix_sources
from tracemill.llm.pii import redact_personal_data
from tracemill.llm.quality_model import keep_quality, train_quality_model, training_labels


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, after a change of text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of those given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, train_quality_model(docs, training_labels(labels)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return recounted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return recounted(redact_personal_data(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes, with copy_no and what decided it."""
    return emit_copies(mix_sources(docs))


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard", deduplicate),
    ("decontamination", remove_benchmark),
    ("pii", redact),
    ("mixing", mix),
]

#: The classifier, the suffix automaton's cuts and the boosted trees have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back for the next.

    A stage's table goes once the next one is written. Null and empty texts, repeated rows and an empty table pass
    through every stage as its operator defines; more columns of ``documents`` stay as they are.
    """
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = work.table(name, stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        before = name
    return docs
