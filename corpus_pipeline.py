"""Corpus pipeline: toxicity, near duplicates, decontamination, PII, byte-level BPE.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor
kept. ``run`` writes each result as Parquet to the shared scratch folder and reads it
back as the next stage's documents. All stages but the last return the columns of
``documents``, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm.common import prepare, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject, row by row."""
    from marketlens.llm.toxicity import without_toxic
    prepare(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    from marketlens.llm.jaccard_join import without_duplicates
    prepare(spark)
    return without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    from marketlens.llm.decontaminate import without_contaminated
    prepare(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data and disclosing terms masked in the text."""
    from marketlens.llm.pii import sanitised
    prepare(spark)
    return sanitised(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    from marketlens.llm.queries import bpe_digests
    prepare(spark)
    # A small cache: workers that earlier stages used idle beside this one's.
    return bpe_digests(docs.select("doc_id", "text"), cache_entries=60_000)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("pii", pii), ("byte_bpe", byte_bpe)]

#: No SQL: the toxicity grammar and the tokenizer can't be expressed in it; tests/llm checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
