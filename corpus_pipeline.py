"""A corpus pipeline: language ID, near-duplicates, decontamination, secrets, mixing.

Each stage reads what its predecessor wrote; the tables between the stages lie in
the shared folder, so a lost executor costs a stage's tasks, not the pipeline.

Defined cases, for all stages: an empty table stays empty; columns beside those of
documents are carried along under any name; repeated rows are judged alike (of
near-duplicates with one id, all that carry the smallest id stay); very long texts
are read in slices.  Each stage states its nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, language, minhash_forest, mixing, secrets
from gridloom.llm.store import Store, released


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too), whose best language has too low a score or whose letters are unlike that language's, go; a null lang is not learned from."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays; rows with a null id or an empty text stay."""
    return minhash_forest.keep_one(spark, docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark and n_chars follows; no document goes, a null text stays null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the number of copies and the source's target; a null source is one of its own, texts without words go."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: Language models and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with released():  # a stage's own tables go when its result is stored
            stored = store.put(stage(spark, docs, sf_dir))
        if k:
            store.drop(docs)
        docs = stored
    return docs
