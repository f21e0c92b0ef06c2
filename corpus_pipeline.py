"""The corpus pipeline: quality rules, near-dedup, secret masking, mixing and packing, each over all that the one before kept."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkquiver.llm import mixing, neardup, packing, quality, secrets
from sparkquiver.operators.components import ensure_checkpoint_dir, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those with a null or empty text among them."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at 80 % of similarity or more, the document with the smallest id stays, and so does what has
    no words or no id."""
    return neardup.keep_one(docs, per_cent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, and null texts stay null."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn words of each document; a document drawn from in two epochs comes twice, one without words not at all. Null sources
    are one source."""
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("pack_windows", pack_windows)]

#: Masking and packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. What a stage returns is written to the checkpoint folder and read again; it is
    deleted there once the next stage's rows are written. Each stage says in its operator what it does with nulls, empty texts,
    repeated rows and clashing names; no documents give no pieces."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir().rstrip(os.sep)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:
            remove(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
