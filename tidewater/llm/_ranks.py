"""Exact ranks and running sums inside very large groups, without one task a group.

A window over a whole group puts the group into one task. Here every row has a
position in [0, 1) that grows with the wanted order and is spread evenly, so the
group is cut into buckets of bounded size; sums of whole buckets give each
bucket's start, and only rows inside a bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket holds about this many rows, so that one task can sort it.
ROWS_PER_BUCKET = 2_000
#: More buckets a group than this aren't made; the table of their sums stays small.
MOST_BUCKETS = 65_536


def buckets_for(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts' text, the same on every run."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def text_key(value: Column) -> Column:
    """A string that is never null and differs for null and for every value."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value.cast("string")))


def running(rows: DataFrame, group: str | None, position: Column, order: list[Column], sums: dict[str, Column], buckets: int) -> DataFrame:
    """Add, for each name in sums, what precedes the row in its group.

    group is a column without nulls or None for all rows. Adds `{name}_before`,
    the sum over all earlier rows of the group, and `{name}_all`, the group's sum.
    Rows that order can't tell apart come in any order.
    """
    keys = ["_bucket"] if group is None else [group, "_bucket"]
    cut = rows.withColumn("_bucket", F.least(F.floor(position * buckets).cast("int"), F.lit(buckets - 1)))
    totals = cut.groupBy(*keys).agg(*[F.sum(v).alias(f"_{k}_bucket") for k, v in sums.items()])
    whole = Window.partitionBy(*([] if group is None else [group]))
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_{k}_bucket").over(earlier), F.lit(0)).alias(f"_{k}_start") for k in sums],
        *[F.sum(f"_{k}_bucket").over(whole).alias(f"{k}_all") for k in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(starts, keys)
    for k, v in sums.items():
        out = out.withColumn(f"{k}_before", F.col(f"_{k}_start") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_bucket", *[f"_{k}_start" for k in sums])
