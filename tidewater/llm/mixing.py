"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget of words by weight, none above a multiple of its own size.
Complete epochs come first: while a source's target covers all of it, every document
is taken whole. What is left is filled by documents in the order of exponential keys
divided by their quality weight, smallest first, which draws without replacement in
proportion to quality; a running sum of words ends the selection at the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import _ranks
from tidewater.llm._store import stored

SEED = "mixture-1"
#: Weights of the sources by code point of their name, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The budget in shares of all words, and the most that a source gives in shares of its own.
BUDGET, MOST = 1.5, 2.0
#: Quality weights lie between these.
LEAST_WEIGHT, FULL_WEIGHT = 0.25, 1.0


def words(text: Column) -> Column:
    """Runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """The share of letters of any script in the text's characters that aren't white space.

    Lies between the least and the full weight; marks on letters count as letters.
    """
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    share = F.coalesce(letters / F.nullif(F.char_length(F.regexp_replace(text, r"[\x09-\x0D\x20]", "")), F.lit(0)), F.lit(0.0))
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(FULL_WEIGHT), share))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Add `target` to one row per source (source, source_size).

    Shares the budget by weight; what a source can't give is shared again by weight
    among the rest until none is above its most. Sources that fill up are those with
    the least capacity per weight, so one ordered pass finds them all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    filling = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", budget * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(filling), F.lit(0.0)))
    rows = rows.withColumn("_weights", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(filling), F.lit(0.0)))
    rows = rows.withColumn("_level", F.col("_left") / F.col("_weights")).withColumn("_n", F.row_number().over(order))
    # The first source that doesn't fill up sets the level of all behind it.
    stays = F.col("_cap") / F.col("_w") > F.col("_level")
    level = F.min_by(F.when(stays, F.col("_level")), F.when(stays, F.col("_n"))).over(every)
    return rows.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap"))).select("source", "source_size", "target")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, with_text: bool = False) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, size, source_size, target (its source's) and taken (the words,
    repeats counted: a multiple of the size). A null source is a source of its own,
    a null or empty text has size 0 and nothing is taken of it. Rows with equal ids
    draw by their texts, so an id on very many rows is no group of its own; equal rows
    come in any order. Reruns give the same rows. An empty table gives none; other
    columns are ignored. with_text adds the text's md5 (of a null text, of nothing).
    """
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"),
        quality_weight(F.col(text_col)).alias("_weight"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_text"),
    )
    rows = rows.withColumn("_source", _ranks.text_key(F.col("source")))
    key = -F.log(_ranks.unit_hash(F.lit(seed), _ranks.text_key(F.col("doc_id")), F.col("_text"))) / F.col("_weight")
    # Texts are read once; what follows needs a few numbers of each document.
    rows = stored(rows.withColumn("_key", key).drop("_weight"))
    # Grows with the key; no bucket holds more than full over least weight times its share.
    position = 1 - F.exp(-LEAST_WEIGHT * F.col("_key"))
    buckets = _ranks.buckets_for(rows.count())
    order = [F.col("_key"), F.col("size"), F.col("doc_id"), F.col("_text")]
    run = _ranks.running(rows, "_source", position, order, {"_words": F.col("size")}, buckets)
    sizes = rows.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes.drop("_source")).withColumn("_source", _ranks.text_key(F.col("source"))).drop("source")
    joined = run.drop("source").join(goals, "_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    # A document at the edge is taken if at least half of it fits.
    more = (F.col("_words_before") + F.col("size") / 2 <= rest).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * (whole + more)).cast("long").alias("taken"), *([F.col("_text").alias("text_md5")] if with_text else []))
