"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import ann, html, mixing, oracles, pieces, quality, sharding, simhash, toxicity, urls, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document whose number its path holds."""
    pages = _table(spark, sf_dir, "pages")
    number = F.regexp_extract(urls.path(F.col("url")), "/([0-9]+)", 1).try_cast("bigint")
    judged = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    outcomes = pages.select("page_id", number.alias("doc_id")).join(judged, "doc_id").select("page_id", "bad")
    return urls.judge(pages, outcomes, URL_RULES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.neighbours(_table(spark, sf_dir, "documents"))
    for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        rows = rows.withColumn(f"{c}_hashes", winnowing.hashes(F.col(c)))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        winnowing.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("fingerprint_hashes"), F.col("edited_fingerprint_hashes")).alias("near_edited"),
        winnowing.likeness(F.col("fingerprint_hashes"), F.col("next_fingerprint_hashes")).alias("near_next"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


_ORACLE = {
    "op1_url_filter": oracles.url_filter(URL_RULES),
    "op2_sharding": oracles.sharding_rows(),
    "op8_mixing": oracles.mixing_rows(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
