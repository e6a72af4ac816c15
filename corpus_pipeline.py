"""Cleaning a text corpus in five stages, each written and read again by its caller.

Toxic documents go; one document of each group of near-duplicates stays;
sentences of repeated passages go; secrets are redacted; what is left is packed
into training sequences. All stages but the last return the columns of
``documents`` (doc_id, text, lang, source, n_chars and any others).
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import packing, secrets, simhash, substring, toxicity
from timberline.llm.common import ensure_checkpoint_dir


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` anew, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's input, does not reject."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), the one with the least id; rows, not ids, are the documents."""
    return simhash.one_of_each(docs, width=5, lanes=8, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of passages that stand earlier in the corpus."""
    return _counted(substring.without_repeats(docs).drop("removed_sentences"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets redacted."""
    return _counted(secrets.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substring", substring_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: A fitted classifier, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared checkpoint folder."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
