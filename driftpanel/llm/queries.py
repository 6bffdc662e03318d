"""One query per text operator, each over its whole table, and the SQL of those that have one."""

from __future__ import annotations

import functools
import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.llm import decontaminate, hard_negatives, license_scan, link_graph, minhash_dedup, mixing_lm
from driftpanel.llm import oracle, piece_codec, quality_rules, secret_scan, spelling_variants, substring_dedup
from driftpanel.llm import toxicity, vector_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(1)
def piece_model(path: str | None = None) -> bytes:
    """The model file's bytes; by default the public one beside the installed libraries."""
    if path is None:
        path = Path(importlib.util.find_spec("public_tokenizers").origin).parent / "piece_bpe_32k.model"
    return Path(path).read_bytes()


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge_urls(_table(spark, sf_dir, "pages"))


def op5_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(_table(spark, sf_dir, "documents"), piece_model())


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        toxicity.is_held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*columns, "base_failed", "kept", "rejected_by")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_spellings(_table(spark, sf_dir, "documents"))


def op12_tiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_paragraph_minhash,
        op2_benchmark_decontamination,
        op3_minhash_near_dedup,
        op4_link_graph_urls,
        op5_context_mixing_lm,
        op6_sentencepiece_codec,
        op7_counterfactual_toxicity,
        op8_assignment_secrets,
        op9_license_scan,
        op10_quality_rules,
        op11_spelling_variants,
        op12_tiled_vectors,
        op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": oracle.OVERLAPS,
    "op3_minhash_near_dedup": oracle.NEAR_DUPLICATES,
    "op11_spelling_variants": oracle.SPELLING,
    "op12_tiled_vectors": oracle.VECTORS,
    "op13_hard_negatives": oracle.NEGATIVES,
}
