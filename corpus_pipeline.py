"""Corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last return the columns of
``documents``.

Edge cases: a document without a doc_id goes through all stages like any other; null text is not
toxic, has no duplicates, passages or secrets, and is encoded as null. Of rows that repeat both
doc_id and text one stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.llm import decontaminate, minhash_dedup, piece_codec, queries, secret_scan, toxicity
from driftpanel.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus's labels, scores below 1/2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.where("score < 0.5").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return minhash_dedup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that also stand in a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.cut_spans(decontaminate.find_overlaps(docs, benchmark), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every secret."""
    return secret_scan.redact(secret_scan.find_secrets(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the parity and round-trip checks."""
    return piece_codec.encode_pieces(docs, queries.piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: No SQL expresses the fitted classifier or the encoding; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
