"""Nearest neighbours by additive quantisation, with an exact check by error bounds.

A vector's direction from a centre is coded as a sum of full-dimensional codewords, one
from each codebook. The codebooks are fitted one after another on the residuals of a
bounded sample; encoding keeps a beam of the best partial sums. A query's inner products
with all codewords form a lookup table, so a coded vector's score is a sum of table
entries; distances take the stored norm of the coded sum too.

The index holds of each vector its code, that norm, its length from the centre and how
far the coded sum lies off: a score by table can't be wrong by more. It is laid into
blocks of bounded size. Every query meets the codes of a block; the best by table are
scored exactly, and then every other vector that could still be as near by its bound.
So nothing is missed, however badly the codes fit the rows: then more are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._store import stored

#: Vectors that the codebooks are fitted on, drawn by their id's hash.
SAMPLE = 8_192
CODEBOOKS, CODEWORDS, BEAM, ROUNDS, SEED = 32, 256, 2, 10, 11
#: Vectors of a block: few where that keeps MANY blocks busy, at most the larger number.
SMALL, LARGE, MANY = 4_096, 65_536, 64
#: Queries that meet a block together, and how many candidates of a query are scored exactly first.
QUERIES, RERANK = 8_192, 160
#: Bytes of a block's vectors or queries, scores held at once, share of a block left over at which it is multiplied as a whole.
BYTES, SCORES, DENSE = 32 << 20, 1 << 20, 1 / 16


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # codebook, codeword, dimension

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (one byte per codebook) and the squared norms of the coded sums."""
        codes, norms = [], []
        for part in np.array_split(vectors, max(1, -(-len(vectors) // 2048))):
            rest, path = part[:, None, :], np.zeros((len(part), 1, 0), dtype=np.uint8)
            for words in self.words:
                beams, many = rest.shape[1], len(words)
                dots = (rest.reshape(-1, rest.shape[2]) @ words.T).reshape(len(part), beams, many)
                error = ((rest**2).sum(2)[:, :, None] - 2 * dots + (words**2).sum(1)).reshape(len(part), -1)
                width = min(BEAM, beams * many)
                best = np.argpartition(error, width - 1, axis=1)[:, :width]
                beam, word = best // many, best % many
                path = np.concatenate([np.take_along_axis(path, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
                rest = np.take_along_axis(rest, beam[:, :, None], 1) - words[word]
            last = (rest**2).sum(2).argmin(1)
            row = np.arange(len(part))
            codes.append(path[row, last])
            norms.append(((part - rest[row, last]) ** 2).sum(1))
        return np.concatenate(codes), np.concatenate(norms)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """(vector, query) inner products by table; less half the norms for distances."""
        total = np.zeros((len(codes), len(queries)), dtype=np.float32)
        for m, words in enumerate(self.words):
            total += (words @ queries.T)[codes[:, m]]
        return total if norms is None else total - norms[:, None] / 2

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """The coded vectors, in double precision."""
        total = np.zeros((len(codes), self.words.shape[2]))
        for m, words in enumerate(self.words):
            total += words[codes[:, m]]
        return total

    def rounding(self) -> float:
        """What single precision can change in a table score of a query of length one."""
        books, _, size = self.words.shape
        return (books + size) * 2.0**-23 * float(np.sqrt((self.words.astype(np.float64) ** 2).sum(2)).max(1).sum())


def fit(sample: np.ndarray) -> Codebooks:
    """Residual codebooks by k-means on the sample; fewer codewords for few vectors."""
    random = np.random.default_rng(SEED)
    rest, books = sample.astype(np.float32), []
    for _ in range(CODEBOOKS):
        many = min(CODEWORDS, len(rest))
        words = rest[random.permutation(len(rest))[:many]].copy()
        for _ in range(ROUNDS):
            nearest = ((words**2).sum(1) - 2 * rest @ words.T).argmin(1)
            one = np.zeros((many, len(rest)), dtype=np.float32)
            one[nearest, np.arange(len(rest))] = 1
            count = one.sum(1)
            words = np.where(count[:, None] > 0, one @ rest / np.maximum(count, 1)[:, None], rest[random.integers(0, len(rest), many)])
        books.append(words)
        rest = rest - words[((words**2).sum(1) - 2 * rest @ words.T).argmin(1)]
    return Codebooks(np.stack(books))


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def _lengths(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    top[top == 0] = 1
    return top[:, 0] * np.sqrt(((rows / top) ** 2).sum(axis=1))


def _directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in single precision, and the lengths they had (1 for none)."""
    lengths = _lengths(rows)
    lengths[lengths == 0] = 1
    return np.nan_to_num(rows / lengths[:, None]).astype(np.float32), lengths


def _exact(vectors: np.ndarray, query: np.ndarray, far: bool) -> np.ndarray:
    return -((vectors - query) ** 2).sum(axis=-1) if far else (vectors * query).sum(axis=-1)


def _by_code(books: Codebooks, centre: np.ndarray, query: np.ndarray, coded: tuple[np.ndarray, ...], far: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) scores by table, and the most that the exact ones can be."""
    codes, norm, length, error = coded
    start, size = query - far * centre, query.shape[1]
    unit, long = _directions(start)
    dots = np.ascontiguousarray(books.scores(unit, codes).T) * length
    off, long = books.rounding() * length, long[:, None]
    tiny = 1e-15 * size * (2 * _lengths(centre[None])[0] + far * long)
    if far:
        square = long**2 - 2 * long * dots + length**2 * norm
        least = square - 2 * long * off - 1e-5 * length**2 * norm - 1e-14 * size * long**2
        return -square, -(np.maximum(np.sqrt(np.maximum(least, 0)) - error - tiny, 0) ** 2)
    return long * dots, (query @ centre)[:, None] + long * (dots + off + error + tiny)


def _by_product(vectors: np.ndarray, query: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) scores by one matrix product, and how far rounding can put them off."""
    dots, ours, theirs = query @ vectors.T, _lengths(query)[:, None], _lengths(vectors)
    if far:
        return 2 * dots - ours**2 - theirs**2, 4e-15 * vectors.shape[1] * (ours + theirs) ** 2
    return dots, 1e-15 * vectors.shape[1] * ours * theirs


def _pairs(columns: list[list[np.ndarray]]) -> pa.Table:
    q, r, s = (np.concatenate([*c, np.empty(0, kind)]).astype(kind) for c, kind in zip(columns, (np.int64, np.int64, np.float64), strict=True))
    return pa.table({"query_id": q, "rep": r, "score": s})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) without null ids and vectors that are null, empty, zero or not finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(vector_col, lambda x: x != 0)
    held = vectors.where(F.col(id_col).isNotNull() & finite & nonzero)
    return held.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _heads(words: np.ndarray, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the sample's rows lie, by their nearest first codeword."""
    nearest = ((words**2).sum(1) - 2 * unit @ words.T).argmin(1)
    heads = words.astype(np.float64) * np.median(lengths)
    for word in np.unique(nearest):
        mine = nearest == word
        heads[word] = (unit[mine] * lengths[mine, None]).mean(axis=0)
    return heads


def _list_size(rerank: int, blocks: int) -> int:
    """How many candidates of a query a block scores first: its share of rerank, about Poisson, and six deviations."""
    mean = rerank / blocks
    return min(rerank, math.ceil(mean + 6 * math.sqrt(mean) + 6))


def search(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rerank: int | None = RERANK,
    probes: int | None = None,
    metric: str = "inner",
) -> DataFrame:
    """The k nearest of every vector whose id is divisible by `every`, itself left out.

    Nearness is the inner product in double precision, or with metric "l2" the distance
    (then score is its negative square); ties go to the smaller id. Returns query_id,
    rank (from 1), vec_id and score. The result is exact: beside the `rerank` best by code
    all are compared that the codes don't rule out. rerank=None compares all without codes.
    With probes a query meets the vectors only whose first codeword is one of its best so
    many, and may miss others; None means all.

    Equal vectors are coded and compared once and told apart by id at the end, so a
    very common vector costs no more and no copy is lost. Vectors of another length
    than the commonest take no part; repeated ids count as one row per vector. Fewer
    candidates than k are all returned; an empty table gives no rows. Columns besides
    id and vector are ignored, whatever their names.
    """
    rows = stored(usable(vectors, id_col, vector_col))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("vector") == length["d"])
    # Of equal vectors k + 1 are enough: the smallest ids, one of which may be the query.
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.withColumn("_n", first).where(F.col("_n") <= k + 1)
    distinct = stored(distinct.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.collect_set("vec_id").alias("members")))
    sample = _matrix(distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow().column(0), np.float64)
    centre = np.median(sample, axis=0)
    unit, lengths = _directions(sample - centre)
    words = fit(unit).words if rerank or probes else None
    heads = _heads(words[0], unit, lengths) if probes else None
    books = rows.sparkSession.sparkContext.broadcast((words, centre, heads))
    far = metric == "l2"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, centre, _ = books.value
        coder = Codebooks(words)
        for batch in batches:
            for part in (batch.slice(top, 2048) for top in range(0, batch.num_rows, 2048)):
                rows = _matrix(part.column(1), np.float64) - centre
                unit, lengths = _directions(rows)
                codes, norms = coder.encode(unit)
                errors = _lengths(rows - lengths[:, None] * coder.sums(codes)) * (1 + 1e-12)
                more = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(lengths), pa.array(errors)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=["rep", "vector", "code", "norm", "length", "error"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centre, heads = books.value
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column(1), np.float64) - far * centre) @ heads.T - (heads**2).sum(1) / 2 * far
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=["vec_id", "vector", "cells"])

    total = distinct.count()
    index = distinct.select("rep", "vector")
    if words is not None:
        index = index.mapInArrow(code, "rep long, vector array<double>, code binary, norm float, length double, error double")
    if probes:
        index = stored(index)
    width = 8 * length["d"]
    large = max(1, min(LARGE, BYTES // width))
    small = min(SMALL, large)
    cell = F.conv(F.hex(F.substring("code", 1, 1)), 16, 10).cast("int") if probes else F.lit(0)
    largest = index.groupBy(cell.alias("c")).count().agg(F.max("count")).first()[0] if probes else total
    # A cell has as many blocks as its rows need; without probes all rows are one cell.
    blocks = max(1, -(-largest // large), min(MANY if not probes else 1, -(-largest // small)))
    index = index.withColumn("block", cell * blocks + F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    groups = max(1, -(-asked.count() // max(1, min(QUERIES, BYTES // width))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    asked = asked.withColumn("queries", own)
    met = asked.select("vec_id", "vector").mapInArrow(cells, "vec_id long, vector array<double>, cells array<int>").withColumn("queries", own) if probes else asked.withColumn("cells", F.array(F.lit(0)))
    met = met.withColumn("cell", F.explode("cells")).withColumn("salt", each(blocks)).selectExpr("vec_id", "vector", "queries", f"cell * {blocks} + salt AS block")

    def nearest(found: pa.Table, wanted: pa.Table) -> pa.Table:
        """The k + 1 nearest of each query in a block."""
        out: list[list[np.ndarray]] = [[], [], []]
        if found.num_rows and wanted.num_rows:
            reps, names = found.column("rep").to_numpy(), wanted.column("vec_id").to_numpy()
            vectors, query = _matrix(found.column("vector"), np.float64), _matrix(wanted.column("vector"), np.float64)
            many = len(reps)
            step = max(1, min(64, SCORES // many))
            if rerank:
                coder, centre = Codebooks(books.value[0]), books.value[1]
                codes = np.frombuffer(b"".join(found.column("code").to_pylist()), dtype=np.uint8).reshape(many, -1)
                coded = (codes, *(found.column(c).to_numpy().astype(np.float64) for c in ("norm", "length", "error")))
                take = min(max(k + 1, _list_size(rerank, blocks)), many)
                step = max(1, min(step, BYTES // (width * take)))
            for top in range(0, len(names), step):
                some = query[top : top + step]
                kept = np.ones((len(some), many), dtype=bool)
                # Comparisons are turned so that what isn't a number is kept.
                if rerank and many > k + 1:
                    likely, most = _by_code(coder, centre, some, coded, far)
                    first = np.argpartition(-likely, take - 1, axis=1)[:, :take]
                    floor = np.partition(_exact(vectors[first], some[:, None], far), take - k - 1, axis=1)[:, take - k - 1]
                    kept = ~(most < (floor - 1e-12 * np.abs(floor))[:, None])
                if many > k + 1 and kept.mean() > DENSE:
                    score, slack = _by_product(vectors, some, far)
                    floor = np.partition(score - slack, many - k - 1, axis=1)[:, many - k - 1]
                    kept &= ~(score + slack < floor[:, None])
                for i, name in enumerate(names[top : top + step]):
                    places = np.flatnonzero(kept[i])
                    score = _exact(vectors[places], some[i], far)
                    best = np.lexsort((reps[places], -score))[: k + 1]
                    for column, values in zip(out, (np.full(len(best), name), reps[places][best], score[best]), strict=True):
                        column.append(values)
        return _pairs(out)

    held = index.withColumn("queries", each(groups))
    pairs = held.groupBy("queries", "block").cogroup(met.groupBy("queries", "block")).applyInArrow(nearest, "query_id long, rep long, score double")
    ahead = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    pairs = pairs.repartition("query_id").distinct().withColumn("_n", F.row_number().over(ahead)).where(F.col("_n") <= k + 1)
    hits = pairs.join(distinct.select("rep", "members"), "rep").select("query_id", "score", F.explode("members").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = hits.where("vec_id <> query_id").withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
