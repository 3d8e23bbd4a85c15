"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, source mix.

``run`` applies the stages to ``documents``; each stage is written as Parquet and read back, and
works on all rows that its predecessor kept.  Null or empty texts are of no known language and go with the
first stage; null sources are a source of their own; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltlens.llm import decontam, langid, mixing, secrets, simhash
from voltlens.llm.common import read_table, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay: one with letters whose language holds half of its words or more."""
    return langid.keep_identified(docs, langid.fit(langid.training_sample(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts (five-word shingles, Jaccard 0.8) stays, the one with the smallest id."""
    return simhash.keep_one_per_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    return secrets.redact(docs, secrets.train(secrets.default_samples(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix holds, with the number of their copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
]

#: A fitted field, fingerprints, character models and knapsack choices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
