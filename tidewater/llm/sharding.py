"""Proportional stratified interleaving of rows into shards that all match the mixture.

Within each source rows are ranked by a seeded hash. A row's fractional rank, its rank
over its source's size from a start that differs by source, is where it stands among
all rows; sorted by it, any stretch holds every source in proportion. The order is cut
into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _ranks
from tidewater.llm._store import stored

SEED = "interleave-1"


def interleave(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Shard and slot of every row; the law is `rows`.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; a null text has none), the
    text's unsigned crc32, law, shard (from 0), slot (gapless from 0 in each shard)
    and grown_shard (null: not a law of keys). A null source is a source of its own;
    rows with equal ids draw by their text, so an id on very many rows is no group of
    its own; equal rows come in any order.
    Fewer rows than shards leave the last shards empty.
    """
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        _ranks.text_key(F.col(source_col)).alias("_source"),
    )
    rows = rows.withColumn("size", F.col("_bytes") + 1).drop("_bytes")
    # Texts are read once; what follows needs a few numbers of each document.
    rows = stored(rows.withColumn("_draw", _ranks.unit_hash(F.lit(seed), _ranks.text_key(F.col("doc_id")), F.col("text_crc32"))))
    total = rows.count()
    buckets = _ranks.buckets_for(total)
    order = [F.col("_draw"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    one = {"_rank": F.lit(1)}
    ranked = _ranks.running(rows, "_source", F.col("_draw"), order, one, buckets)
    start = _ranks.unit_hash(F.lit(seed), F.lit("source"), F.col("_source"))
    ranked = ranked.withColumn("_place", (F.col("_rank_before") + start) / F.col("_rank_all")).drop("_rank_before", "_rank_all")
    placed = _ranks.running(ranked, None, F.col("_place"), [F.col("_place"), F.col("_source"), *order], one, buckets)
    each, more = divmod(total, shards)
    at = F.col("_rank_before")
    early = at < more * (each + 1)
    shard = F.when(early, F.floor(at / (each + 1))).otherwise(more + F.floor((at - more * (each + 1)) / max(each, 1)))
    slot = F.when(early, at % (each + 1)).otherwise((at - more * (each + 1)) % max(each, 1))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
