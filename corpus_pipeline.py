"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

quality      rejects documents that the rule ensemble scores below 0.7
near_copies  keeps the first document of each near-duplicate class
leaks        removes documents that overlap a benchmark item
secrets      replaces credentials in the texts (copied examples stay), and corrects n_chars
pieces       encodes every text and returns counts and digests of ids and decoded text

Every stage works on all that its predecessor kept, whole texts, and judges by what that input holds. All but the last
return the columns of documents. Null and empty texts are kept or rejected by the quality stage like any other.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.llm import order_minhash, piece_bpe, rule_ensemble, secrets, spaced_seeds  # noqa: E402
from newsloom.llm.catalog import PIECE_MODEL  # noqa: E402
from newsloom.llm.common import stored, table  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.first_of_classes(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(piece_bpe.encode_decode(docs, public_tokenizers.path(PIECE_MODEL)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("secrets", redacted), ("pieces", pieces),
]
#: A fitted ensemble, sketches, alignments and merging are not SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
