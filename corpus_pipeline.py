"""The corpus pipeline: a chain of training-data operators over documents.

Each stage takes the documents that its predecessor kept, with their columns; the
last one gives the encoded mixture. A document that the mixture takes twice is two
rows from there on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import mixing, pieces, quality, simhash, toxicity
from tidewater.llm._labelled import remainder
from tidewater.llm._ranks import text_key
from tidewater.llm._store import mark, prune, stored

#: Near copies are fingerprints that differ in so many of their 64 bits at most.
RADIUS = 3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row in one column, besides doc_id and text: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the rule ensemble, fitted on this stage's input, accepts.

    Null texts are judged as empty ones; rows with null columns, repeated rows and columns
    of any name are kept or dropped as they are; an empty table gives none.
    """
    model = quality.train(docs, _labels(spark, sf_dir), remainder(F.col("doc_id"), 5) == 0)
    rows, _ = quality.with_statistics(_packed(docs))
    # The mark keeps the filter above the statistics: pushed below, every rule would
    # count its patterns anew.
    scored = rows.select("row", model.score().alias("score"), F.monotonically_increasing_id().alias("mark"))
    return scored.where((F.col("score") >= quality.THRESHOLD) & (F.col("mark") >= 0)).select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below the threshold by compression distance.

    Nulls, empty texts, repeated rows and odd columns are treated as in the stage before.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, _labels(spark, sf_dir), remainder(F.col("doc_id"), 3) == 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep exactly one row of every group of near copies: the one with the least id.

    Rows without an id come last in their group. Texts that aren't near copies all stay,
    also with one id; of rows with equal id and text any one stays. Null and empty texts
    are copies of each other; an empty table gives none.
    """
    kept = stored(simhash.representatives(docs, radius=RADIUS))
    rows = _packed(docs).withColumns(simhash.text_hashes())
    keys = ["id", "hash", "check"]

    def found(some: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(some["id"]) & (rows["hash"] == some["hash"]) & (rows["check"] == some["check"])
        return rows.join(some, same).select("row", *[some[k] for k in keys])

    # Only rows that are alike are grouped: the other texts aren't shuffled for it.
    once = found(kept.where("alike = 1")).select("row.*")
    return once.union(found(kept.where("alike > 1")).groupBy(*keys).agg(F.first("row").alias("row")).select("row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; what it doesn't take goes.

    Texts without words, null ones too, are never taken. Rows with equal ids are told
    apart by their texts; an empty table gives none.
    """
    times = (F.col("taken") / F.col("size")).cast("long").alias("times")
    taken = mixing.mix(docs, with_text=True).where("taken > 0").select(text_key(F.col("doc_id")).alias("key"), "text_md5", times)
    picked = stored(taken.groupBy("key", "text_md5").agg(F.sum("times").alias("times"), F.count("*").alias("alike")))
    keyed = _packed(docs).withColumn("key", text_key(F.col("doc_id"))).withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    # Rows of equal id and text share their copies evenly, the first ones get the odd
    # ones. The window has the join's keys, so texts are shuffled once.
    rows = keyed.join(picked, ["key", "text_md5"])
    one = F.row_number().over(Window.partitionBy("key", "text_md5").orderBy(F.lit(1)))
    copies = F.floor(F.col("times") / F.col("alike")) + (one <= F.col("times") % F.col("alike")).cast("long")
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row.

    A null text is encoded as an empty one; repeated rows give equal rows.
    """
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("encode", encoded),
]

#: Classifiers, fingerprints and the tokenizer can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each but the last is written and read again.

    Once a stage is written, what it stored on its way and its input are removed.
    """
    begin = mark()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            prune(spark, begin)
    return docs
