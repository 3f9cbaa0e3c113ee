"""Winnowing fingerprints and the neighbour comparison, in DataFrame functions only.

Words are runs without white space. Every k consecutive words give one hash of 37 bits;
of each window of w hashes the least is kept, the rightmost one if several tie, with
its position. Two texts that share any passage of w + k - 1 words share a kept hash.
A text with fewer than k words gives one hash of all its words, one with fewer than
w hashes one window; a text without words, or null, has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A kept hash and its position share a long: the hash's upper bits, then the
#: position counted backwards, so that the least long is the rightmost least hash.
POSITION_BITS = 26
LAST_POSITION = (1 << POSITION_BITS) - 1
#: Neighbours are found inside ranges of about so many rows or bytes of text. Quantiles
#: cut up to MOST_CUTS of them, each is then cut evenly into up to MOST_PARTS.
ROWS_PER_RANGE, BYTES_PER_RANGE = 1_000, 64 << 20
MOST_CUTS, MOST_PARTS = 4_096, 1_024
_FAN = 64


def with_fingerprint(rows: DataFrame, text_col: str, name: str, k: int = 5, w: int = 16) -> DataFrame:
    """Add column `name`: the kept (hash, position) pairs as longs, in text order.

    Positions are exact up to 67 million words; ties beyond that keep the first.
    Steps are separate columns so that Spark computes each once per row.
    """
    h, g, m, q, out = (f"_{name}_{x}" for x in "hgmqo")
    later = lambda array, i, step, n: [F.get(F.col(array), i + step * j) for j in range(1, n)]
    grams = lambda array: F.greatest(F.size(array) - (k - 1), F.least(F.size(array), F.lit(1)))
    back = lambda i: F.lit(LAST_POSITION) - F.least(i, F.lit(LAST_POSITION))
    key = lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, *later(h, i, 1, k)), POSITION_BITS + 1), POSITION_BITS).bitwiseOR(back(i).cast("long"))
    rows = rows.withColumn(h, F.transform(F.expr(f"regexp_extract_all(coalesce(`{text_col}`, ''), r'{WORD}', 0)"), lambda x: F.xxhash64(x)))
    rows = rows.withColumn(g, F.slice(F.transform(h, key), F.lit(1), grams(h)))
    # The least of w is taken in two passes of about the square root of w each.
    inner = next(n for n in range(int(w**0.5), 0, -1) if w % n == 0)
    rows = rows.withColumn(m, F.transform(g, lambda x, i: F.least(x, *later(g, i, 1, inner)) if inner > 1 else x))
    rows = rows.withColumn(q, F.transform(m, lambda x, i: F.least(x, *later(m, i, inner, w // inner)) if w > inner else x))
    windows = F.greatest(F.size(q) - (w - 1), F.least(F.size(q), F.lit(1)))
    return rows.withColumn(out, F.array_distinct(F.slice(q, F.lit(1), windows))).withColumnRenamed(out, name).drop(h, g, m, q)


def hashes(fingerprint: Column) -> Column:
    """The kept hashes without their positions."""
    return F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, POSITION_BITS))


def pairs(fingerprint: Column) -> Column:
    """The kept hashes and word positions (from 0) as an array of structs."""
    return F.transform(
        fingerprint,
        lambda x: F.struct(F.shiftrightunsigned(x, POSITION_BITS).alias("hash"), (F.lit(LAST_POSITION) - x.bitwiseAND(F.lit(LAST_POSITION))).alias("position")),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def as_text(fingerprint: Column) -> Column:
    """hash@position pairs joined by spaces; an empty string for an empty fingerprint."""
    return F.array_join(F.transform(pairs(fingerprint), lambda p: F.concat_ws("@", F.lower(F.hex(p["hash"])), p["position"])), " ")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, by two short scans."""
    if not bounds:
        return F.lit(0)
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    chunks = [bounds[i : i + _FAN] for i in range(0, len(bounds), _FAN)]
    coarse = F.size(F.filter(long([c[-1] for c in chunks]), lambda x: x <= key))
    fine = F.size(F.filter(F.get(F.array(*[long(c) for c in chunks], F.array().cast("array<bigint>")), coarse), lambda x: x <= key))
    return F.least(coarse * _FAN + fine, F.lit(len(bounds)))


def _hash_part(hashed: Column, parts: int) -> Column:
    """Which of so many equal parts of all signed hashes a hash lies in."""
    return F.least(F.floor((hashed / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int")


def with_next(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add `next_<column>` from the row with the next id; the last row's is the first's.

    Rows with equal ids follow each other by their text's hash; null ids come last. Ids
    are cut at quantiles into ranges, which grow in number with rows and bytes, and null
    ids by their text's hash; each range is sorted by itself, and its first row is also
    sent to the range before it. Only the cuts reach the driver; the table of the ranges'
    first keys, a few bytes for each, is broadcast.
    """
    key, hashed = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")
    known = rows.where(F.col(id_col).isNotNull()).select(key.alias("key"))
    size = rows.agg(F.count("*"), F.count_if(F.col(id_col).isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min(id_col), F.max(id_col)).first()
    wanted = max(1, min(MOST_CUTS * MOST_PARTS, max(size[0] // ROWS_PER_RANGE, size[2] // BYTES_PER_RANGE)))
    cuts, parts = min(wanted, MOST_CUTS), -(-wanted // MOST_CUTS)
    bounds: list[int] = []
    if cuts > 1 and size[0] > size[1]:
        at = [i / cuts for i in range(1, cuts)]
        bounds = sorted(set(known.agg(F.percentile_approx("key", at, 20 * MOST_CUTS)).first()[0]))
    span = _range_of(F.col("_key"), bounds)
    if parts > 1 and size[0] > size[1]:
        ends = [int(size[3]), *bounds, int(size[4])]
        long = F.array(*[F.lit(x).cast("long") for x in ends])
        low, high = F.get(long, span), F.get(long, span + 1)
        share = (F.col("_key") - low) / F.greatest((high - low).cast("double"), F.lit(1.0))
        span = span * parts + F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1)).cast("int")
    # Rows without an id lie behind all ranges of ids.
    alone = max(1, min(MOST_CUTS, size[1] // ROWS_PER_RANGE))
    span = F.when(F.col(id_col).isNull(), (len(bounds) + 1) * parts + _hash_part(F.col("_hash"), alone)).otherwise(span)
    placed = rows.withColumn("_key", key).withColumn("_hash", hashed).withColumn("_range", span)
    every = Window.orderBy("_range")
    firsts = placed.groupBy("_range").agg(F.min(F.struct("_key", "_hash")).alias("_first"))
    before = F.coalesce(F.lag("_range").over(every), F.max("_range").over(Window.partitionBy())).alias("_before")
    placed = placed.join(F.broadcast(firsts.select("_range", "_first", before)), "_range")
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("range"), F.lit(True).alias("guest"))
    is_first = (F.col("_key") == F.col("_first._key")) & (F.col("_hash") == F.col("_first._hash"))
    placed = placed.withColumn("_at", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own)))).drop("_first", "_before")
    order = Window.partitionBy("_at.range").orderBy("_at.guest", "_key", "_hash", "text")
    following = F.lead(F.struct(*columns)).over(order)
    return placed.withColumn("_next", following).where("not _at.guest").select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 16) -> DataFrame:
    """Fingerprints of each document and of its edit, and their likeness.

    The edit replaces the last floor(n/2) of a text's n code points by the first as
    many (or all) of the next document's. Returns doc_id, text, edited_text, the two
    fingerprints and the next document's. Null texts count as empty; equal texts have
    equal fingerprints; an empty table gives no rows; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fingerprint", k, w), "doc_id", ["text", "fingerprint"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    return with_fingerprint(rows.withColumn("edited_text", edited).drop("next_text"), "edited_text", "edited_fingerprint", k, w)
