"""Corpus pipeline: language ID, near-duplicates, benchmark passages, secrets, mix.

Each stage works on all that its predecessor kept and takes effect on the documents:

* ``language_id`` drops documents whose language cannot be told,
* ``near_duplicates`` keeps one document of each group of five-word Jaccard similarity 0.8 or more,
* ``decontaminate`` cuts benchmark passages and drops documents that are mostly passage,
* ``secrets`` replaces every secret by a mark,
* ``mix`` orders the documents for training: one row per reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.llm import decontaminate as passages
from pulsegate.llm import langid, mixing, near_copies, secret_ledger
from pulsegate.session import checkpoint_dir, durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return docs.where(langid.accepted(model, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = durable(secret_ledger.findings(secret_ledger.scan_unseen(docs)))
    return secret_ledger.redact(docs, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings ``doc_id, source, size, target, pass, position, words`` in training order."""
    content = F.coalesce(F.md5("text"), F.lit("")).alias("content")
    sized = durable(docs.select("doc_id", "source", mixing.word_count().alias("size"), content))
    mixed = mixing.mix(sized, mixing.cycle_schedules(mixing.source_sizes(sized)))
    return mixing.training_order(mixed.select("doc_id", "source", "size", "content", "target", "readings"))


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("mix", mix),
]

# Language identification and MinHash cannot be expressed in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
