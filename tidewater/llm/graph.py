"""Connected components of an edge table, by joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._store import scratch, stored

#: A node with very many neighbours is joined as one key for about so many of them.
PER_SALT, MOST_SALTS = 100_000, 4_096


def _stars(edges: DataFrame, larger: bool, salts: int) -> DataFrame:
    """One star operation: tie neighbours to the least node around each node.

    Nodes of up to PER_SALT neighbours are one key; the others are cut into `salts` keys.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if larger:
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    # A small node's neighbours all have salt 0, so only large nodes are written many times:
    # there are at most as many of them as edges over PER_SALT.
    if salts == 1:
        tied = both.join(least, "u")
    else:
        large = F.broadcast(least.where(F.col("n") > PER_SALT).select("u", F.lit(True).alias("large")))
        salt = F.when(F.col("large"), F.pmod(F.xxhash64("v"), F.lit(salts))).otherwise(0).cast("int")
        many = F.when(F.col("n") > PER_SALT, F.lit(salts - 1)).otherwise(0).cast("int")
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), many)))
        tied = both.join(large, "u", "left").withColumn("salt", salt).drop("large").join(salted, ["u", "salt"])
    if larger:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Label every node of the edges (a, b: long) with the least node it reaches.

    Returns (node, component), one row per node. Repeated edges, loops and either
    direction are allowed; edges with a null end are left out; no edges give no rows.
    Alternates large-star and small-star until the edges stay the same; each round
    is written to the shared folder, and all but the last one are removed. Only counts
    and a checksum reach the driver.
    """
    spark = edges.sparkSession
    check = [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]
    with scratch(spark):
        now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        seen = tuple(now.agg(*check).first())
        while seen[0]:
            ends = now.select(F.col("a").alias("u")).union(now.select("b")).groupBy("u").count()
            salts = min(MOST_SALTS, -(-ends.agg(F.max("count")).first()[0] // PER_SALT))
            now = stored(_stars(_stars(now, True, salts), False, salts))
            here = tuple(now.agg(*check).first())
            if here == seen:
                break
            seen = here
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
