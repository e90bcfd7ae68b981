"""A training-corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake.llm import bytebpe, mixing, quality, secrets, simhash
from doselake.llm.common import table
from doselake.session import scratch_path

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.7


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, learnt from ``labels``, scores below ``LEAST_QUALITY``."""
    source = table(spark, sf_dir, "documents")
    weights = quality.train_on_labels(source, table(spark, sf_dir, "labels"))
    names = docs.columns
    scored = quality.score_texts(docs, weights, keep=tuple(n for n in names if n != "doc_id"))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources until the sources have their target weights; none is left out."""
    return mixing.mix(docs, mixing.tempered(docs), keep=tuple(docs.columns), placed=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier is trained, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
