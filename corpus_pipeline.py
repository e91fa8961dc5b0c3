"""A corpus pipeline over ``documents``; each stage reads what the stage before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, decontam, nearcopies, secrets, toxicity
from riskspark.llm.queries import BPE_FILE
from riskspark.session import write_through


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go; the model learns from ``labels``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) the document with the smallest id stays.

    SimHash fingerprints propose pairs by operator 1's index, MinHash keys those that fingerprints don't reach; the Jaccard decides.
    """
    return nearcopies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids, and the digest of the bytes that they decode to."""
    done = bpe.encode_and_decode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return done.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode_bytes),
]

ORACLE_SQL = None  # models, digests and byte-pair merges have no SQL form; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
