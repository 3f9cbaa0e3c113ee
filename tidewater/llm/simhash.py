"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Every text becomes 64 bits: bit i is set if over half of its shingles' XXH64 have
bit i set. Distinct fingerprints are laid into tiles by the population counts of
their four 16-bit parts (eight 8-bit ones for very many). Two fingerprints that differ in r bits have counts
that differ by r at most in sum, so only tiles within the radius of each other are
compared, each such pair of tiles whole, with numpy's exclusive-or and bit counts.
No link is missed and the number of partners isn't capped: a tile gives a spanning
forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._store import stored
from tidewater.llm.graph import components

SEED = 42
#: Up to so many fingerprints tiles are made from four parts of them, beyond from eight.
FEW = 50_000_000
#: A tile's own fingerprints, and those that come to it, are cut into chunks of about so many.
TILE = 32_768
#: Fingerprint pairs in one exclusive-or; bounds a task's memory.
BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, last = b" ".join(words), max(len(words) - shingle, 0)
    begins, stops = [0, *ends[:last].tolist()], (ends[len(words) - 1 - last :] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(begins, stops, strict=True)), dtype="<u8", count=last + 1)
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) of every row, whole texts, nulls as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "fingerprint"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint long")


def _near_offsets(radius: int, parts: int) -> list[np.ndarray]:
    """Count differences that sum to the radius at most, one of each pair of opposites."""
    found = {(0,) * parts}
    for _ in range(radius):
        found |= {(*f[:i], f[i] + d, *f[i + 1 :]) for f in found for i in range(parts) for d in (-1, 1)}
    return [np.array(f, dtype=np.int64) for f in sorted(found) if f > (0,) * parts]


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union the linked places; labels point straight at each component's least place."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (further := labels[labels] != labels).any():
            labels[further] = labels[labels[further]]


def tile_forest(own: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
    """For each place the least place of its component, by links of own places to any.

    own marks the tile's own fingerprints; the others come from tiles within the
    radius and are compared with the tile's own only.
    """
    labels, mine = np.arange(len(bits)), np.flatnonzero(own)
    everyone = np.concatenate([mine, np.flatnonzero(~own)])
    columns = bits[everyone]
    width = max(1, min(len(everyone), BLOCK // 64))
    height = max(1, BLOCK // width)
    for top in range(0, len(mine), height):
        rows = mine[top : top + height]
        for left in range(top // width * width, len(everyone), width):
            near = np.bitwise_count(bits[rows, None] ^ columns[None, left : left + width]) <= radius
            i, j = np.nonzero(near)
            if len(i) > min(len(rows), near.shape[1]):
                _merge(labels, rows[i], everyone[left + j])
            elif len(i) and (other := (u := rows[i]) != (v := everyone[left + j])).any():
                _merge(labels, u[other], v[other])
    return labels


def _tile(bits: Column, parts: int, radius: int) -> Column:
    """The tile of a fingerprint: the bit counts of its parts as one number."""
    width, base = 64 // parts, 64 // parts + 1 + 2 * radius
    count = lambda i: F.bit_count(F.shiftrightunsigned(bits, width * i).bitwiseAND(F.lit((1 << width) - 1)))
    return sum(((count(i) + radius) * base**i for i in range(parts)), F.lit(0)).cast("long")


def links(nodes: DataFrame, radius: int, parts: int | None = None, most: int = TILE) -> DataFrame:
    """Edges (a, b) of node numbers that span the same components as all near pairs.

    nodes: (node long, fingerprint long), one row per distinct fingerprint. Tiles are cut
    into chunks of at most `most` fingerprints; each chunk of a tile is compared with
    itself and with every chunk of the tiles nearby and of its own tile before it, one
    such pair at a time, so that no task holds more than two chunks.
    """
    parts = parts or (4 if nodes.count() <= FEW else 8)
    base = 64 // parts + 1 + 2 * radius
    steps = [int(o @ np.array([base**i for i in range(parts)], dtype=np.int64)) for o in _near_offsets(radius, parts)]
    own = nodes.select("node", F.col("fingerprint").alias("bits"), _tile(F.col("fingerprint"), parts, radius).alias("tile"))
    sizes = own.groupBy("tile").count()
    shifts = F.array(*[F.lit(s).cast("long") for s in (0, *steps)])
    nearby = lambda rows: rows.select(*[c for c in rows.columns if c != "tile"], F.posexplode(F.transform(shifts, lambda s: F.col("tile") + s)).alias("place", "tile"))
    # How many chunks a tile's own fingerprints make, and the strangers that come to it.
    cuts = nearby(sizes).groupBy("tile").agg(F.sum(F.when(F.col("place") == 0, F.col("count"))).alias("n"), F.sum(F.when(F.col("place") > 0, F.col("count"))).alias("m"))
    chunks = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / most).cast("int")
    large = cuts.where((F.col("n") > most) | (F.col("m") > most)).select("tile", chunks(F.col("n")).alias("n"), chunks(F.col("m")).alias("m"))
    laid = nearby(own).join(large, "tile", "left").withColumns({"n": F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)), "m": F.greatest(F.coalesce("m", F.lit(1)), F.lit(1))})
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    theirs = F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")).cast("int")
    cell = lambda chunk, other, owns: F.struct(chunk.cast("int").alias("chunk"), other.cast("int").alias("other"), F.lit(owns).alias("own"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # Chunks of strangers are counted from 0, the tile's own earlier chunks from -1 down.
    native = F.concat(
        F.transform(upto(F.col("m")), lambda j: cell(mine, j, True)),
        F.transform(upto(mine), lambda j: cell(mine, -1 - j, True)),
        F.transform(F.when(mine < F.col("n") - 1, F.sequence(mine + 1, F.col("n") - 1)).otherwise(F.array().cast("array<int>")), lambda k: cell(k, -1 - mine, False)),
    )
    foreign = F.transform(upto(F.col("n")), lambda k: cell(k, theirs, False))
    laid = laid.withColumn("cell", F.explode(F.when(F.col("place") == 0, native).otherwise(foreign)))
    laid = laid.select("tile", "cell.chunk", "cell.other", "cell.own", "node", "bits")

    def compare(table: pa.Table) -> pa.Table:
        own, node, bits = (table.column(k).to_numpy() for k in ("own", "node", "bits"))
        order = np.argsort(node)
        node = node[order]
        labels = tile_forest(own[order], bits[order].view(np.uint64), radius) if own.any() else np.arange(len(node))
        linked = np.flatnonzero(labels != np.arange(len(node)))
        return pa.table({"a": node[linked], "b": node[labels[linked]]})

    return laid.groupBy("tile", "chunk", "other").applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: its id, fingerprint and component.

    Fingerprints link at `radius` or fewer differing bits. component_id is the least
    id that is reached, the row's own included. Null and empty texts have fingerprint
    zero and link like any other. Equal rows give equal rows. A row whose id is null
    has a fingerprint, links nothing and has no component. An empty table gives none;
    other columns of the input are ignored.
    """
    printed = stored(fingerprints(documents, id_col, text_col, shingle))
    nodes = stored(printed.where("id is not null").groupBy("fingerprint").agg(F.min("id").cast("long").alias("node")))
    labels = components(links(nodes, radius))
    classes = nodes.join(labels, "node", "left").select(F.col("fingerprint").alias("_f"), F.coalesce("component", "node").alias("_c"))
    joined = printed.join(classes, printed["fingerprint"] == classes["_f"], "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("_c")).alias("component_id"),
    )


def text_hashes(text_col: str = "text") -> dict[str, Column]:
    """96 bits that stand for a text, in two columns."""
    return {"hash": F.xxhash64(text_col), "check": F.hash(text_col)}


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """The row that stands for each group of near copies: (id, hash, check, alike).

    Groups are those of fingerprints, whatever ids stand on them: different texts with
    one id are apart, and rows without an id link like any other. A group's row is the
    one with the least id, nulls last, then the least text_hashes; alike counts the
    rows that share all three.
    """
    key = F.struct(F.col(id_col).alias("id"), *[h.alias(k) for k, h in text_hashes(text_col).items()])
    keyed = documents.select(key.alias("key"), text_col)
    printed = stored(fingerprints(keyed, "key", text_col, shingle).select("id.*", "fingerprint"))
    nodes = stored(printed.select(F.col("fingerprint").alias("node"), "fingerprint").distinct())
    labels = components(links(nodes, radius)).withColumnRenamed("node", "fingerprint")
    rows = printed.groupBy("id", "hash", "check", "fingerprint").agg(F.count("*").alias("alike")).join(labels, "fingerprint", "left")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "check", "alike")).alias("least")
    return rows.groupBy(F.coalesce("component", "fingerprint")).agg(least).select("least.id", "least.hash", "least.check", "least.alike")
