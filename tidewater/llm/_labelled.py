"""Bounded samples of labelled rows, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many bytes of text of each class are fitted on.
TRAIN_BYTES = 32 << 20


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(documents: DataFrame, labels: DataFrame, label_col: str, keep: Column, each: int, id_col: str = "doc_id", most: int = TRAIN_BYTES) -> DataFrame:
    """(_id, text, label): texts with a 0/1 label, at most `each` rows and `most` bytes per label.

    labels holds id_col and label_col; rows with a null id or label are left out, of
    repeated ids the least label counts, of rows with equal id and text one. Ids are
    drawn by their hash, then texts by theirs; the first text is taken whatever its size.
    Only the drawn keys, which are bounded, are sent to the documents.
    """
    known = labels.where(keep & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    drawn = [known.where(F.col("label") == v).orderBy(*order).limit(each) for v in (0, 1)]
    texts = documents.select(F.col(id_col).alias("_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    sized = texts.select("_id", "_hash", F.octet_length("text").alias("_bytes")).join(F.broadcast(drawn[0].union(drawn[1])), "_id")
    # An id may stand on many rows: rows are drawn anew, one of each text, in the same order.
    rows = sized.groupBy("label", "_id", "_hash").agg(F.max("_bytes").alias("_bytes"))
    before = Window.partitionBy("label").orderBy(*order, "_hash").rowsBetween(Window.unboundedPreceding, -1)
    parts = [rows.where(F.col("label") == v).orderBy(*order, "_hash").limit(each) for v in (0, 1)]
    kept = parts[0].union(parts[1]).withColumn("_so_far", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
    kept = kept.where((F.col("_so_far") == 0) | (F.col("_so_far") + F.col("_bytes") <= most)).select("_id", "_hash", "label")
    return texts.join(F.broadcast(kept), ["_id", "_hash"]).groupBy("_id", "_hash", "label").agg(F.first("text").alias("text")).select("_id", "text", "label")
