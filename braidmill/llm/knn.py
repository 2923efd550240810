"""Exact top-k search as a Voronoi join.

Pivots come from a bounded sample, more of them for more rows; every vector
belongs to the cell of its nearest pivot.  For each cell a summary holds its
number of vectors and its radius R.  For a query q and a vector x of a cell
with pivot p, ``q.p - |q| R <= q.x <= q.p + |q| R``, so the lower bounds of the
cells give each query a score that its k best reach at least, and only cells
whose upper bound gets there can hold one of them.

Queries are grouped by the cells they lie in, neighbouring cells together, into
query blocks.  A cell's vectors are replicated only to the query blocks some
query of which can have an answer there, and queries only to the cells that can
answer them.  Cells are cut into blocks of bounded size, each solved by matrix
products; the blocks' best are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import extended, materialize
from .textops import release_memory

#: Fewest and most pivots; between, a quarter of the square root of the rows.
PIVOTS, MOST_PIVOTS = 64, 8192
#: Vectors and queries of one block, and queries multiplied at once.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK_QUERIES = 16_384, 8192, 256
_EXACT = float(1 << 53)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, is_query, vec array<long>) of all vectors that take part, all of one width."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = embeddings.where(x.isNotNull()).where(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vec"))
    largest = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")) * 256))
    width, most = embeddings.where(x.isNotNull()).where(fine).agg(F.max(F.size(x)), F.max(largest)).first()
    width, most = width or 0, most or 0.0
    if width * (most + 1) * (most + 1) >= 2.0**63:
        raise ValueError(f"components of up to {most / 256:g} in {width} dimensions have inner products that do not fit a long; scale the vectors down")
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))
    query = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", query.alias("is_query"), padded.alias("vec")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating-point numbers where these are exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values; of equal ones the first."""
    if len(row) <= k:
        return np.argsort(-row, kind="stable")
    best = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
    return best[np.argsort(-row[best], kind="stable")[:k]]


def _solve(k: int):
    def unit(data: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_uid", "query_id", "uid", "vec_id", "score"]
        if not len(data) or not len(queries):
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        uid, vec_id = data["uid"].to_numpy(), data["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        order = np.lexsort((uid, vec_id))  # so that ties stay in order of vec_id
        x, q, own, floor = _matrix(data["vec"])[order], _matrix(queries["vec"]), queries["uid"].to_numpy(), queries["floor"].to_numpy()
        place = {u: i for i, u in enumerate(uid[order].tolist())}
        found: list[tuple] = []
        for lo in range(0, len(own), CHUNK_QUERIES):
            scores = _products(q[lo : lo + CHUNK_QUERIES], x)
            for i, row in enumerate(scores, lo):
                best = _best(row, k + 1)
                best = best[(best != place.get(int(own[i]), -1)) & (row[best] >= floor[i])][:k]
                found.append((np.full(len(best), i), order[best], row[best]))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        release_memory()
        return pa.table([pa.array(own[i]), queries["vec_id"].take(pa.array(i)).combine_chunks(), data["uid"].take(pa.array(j)).combine_chunks(), data["vec_id"].take(pa.array(j)).combine_chunks(), pa.array(s)], names=names)

    return unit


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows plus cell and the distance from its pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if len(batch):
                v = _matrix(batch["vec"]).astype(np.float64)
                square = (v * v).sum(1)[:, None] - 2 * v @ p.T + (p * p).sum(1)
                cell = square.argmin(1)
                away = np.sqrt(((v - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(assign, extended(rows.schema, cell="int", away="double"))


def _reached(vec: np.ndarray, points: np.ndarray, summary: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query a score that its k best reach, and whether each cell can hold one of them."""
    count, radius = summary
    norm = np.sqrt((vec * vec).sum(1))[:, None]
    middle, spread = vec @ points.T, norm * radius
    slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
    low, high = middle - spread - slack, middle + spread + slack
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(count[order], axis=1) >= k + 1  # one of them may be the query itself
    at = np.where(enough.any(1), enough.argmax(1), 0)
    floor = np.take_along_axis(low, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
    floor = np.where(enough.any(1), np.floor(np.clip(floor, -9e18, 9e18)), -9.2e18)
    return floor, (high >= floor[:, None]) & (count > 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            yield batch.slice(lo, 1024)


def _targets(queries: DataFrame, points: np.ndarray, summary: np.ndarray, k: int) -> DataFrame:
    """A row per query and cell that can hold one of its k best; floor: a score these reach."""
    shared = queries.sparkSession.sparkContext.broadcast((points, summary))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            floor, fits = _reached(_matrix(batch["vec"]).astype(np.float64), *shared.value, k)
            i, cell = np.nonzero(fits)
            for lo in range(0, len(i), 4096):
                t = batch.take(pa.array(i[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([t["uid"], t["vec_id"], t["vec"], t["query_block"], pa.array(cell[lo : lo + 4096].astype(np.int32)), pa.array(floor[i[lo : lo + 4096]].astype(np.int64))], names=["uid", "vec_id", "vec", "query_block", "cell", "floor"])

    return queries.mapInArrow(bound, "uid long, vec_id long, vec array<long>, query_block int, cell int, floor long")


def _wanted(queries: DataFrame, points: np.ndarray, summary: np.ndarray, k: int) -> DataFrame:
    """(cell, query_blocks): the query blocks to which a cell's vectors go."""
    shared = queries.sparkSession.sparkContext.broadcast((points, summary))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, fits = _reached(_matrix(batch["vec"]).astype(np.float64), *shared.value, k)
            i, cell = np.nonzero(fits)
            both = np.unique(np.stack([cell, batch["query_block"].to_numpy()[i]], 1).astype(np.int32), axis=0) if len(i) else np.zeros((0, 2), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["cell", "query_block"])

    distinct = queries.select("vec", "query_block").mapInArrow(pairs, "cell int, query_block int").distinct()
    return distinct.groupBy("cell").agg(F.collect_list("query_block").alias("query_blocks"))


def query_blocks(points: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Of each cell: its first query block, and over how many its queries are dealt.

    Cells follow one another from neighbour to neighbour; small ones share a block.
    """
    out = [(0, 1)] * len(points)
    left, at, block, filled = np.ones(len(points), bool), 0, 0, 0
    for _ in range(len(points)):
        left[at] = False
        n = int(asked[at])
        if filled and filled + n > BLOCK_QUERIES:
            block, filled = block + 1, 0
        parts = max(1, -(-n // BLOCK_QUERIES))
        out[at] = (block, parts)
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
        if left.any():
            away = ((points - points[at]) ** 2).sum(1)
            at = int(np.where(left, away, np.inf).argmin())
    return out


def _part(uid: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(uid), blocks).cast("int")


def placed(embeddings: DataFrame, k: int, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """(data, queries) by cell, block and query_block: what is replicated to which unit of work."""
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings.select("vec_id", "embedding"))
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows.count()) // 4))
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(pivots).select("vec").collect()
    points = np.unique(np.array([r["vec"] for r in sample], dtype=np.float64).reshape(len(sample), -1), axis=0) if sample else np.zeros((1, 0))
    celled = materialize(_cells(rows, points))
    summary, asked = np.zeros((2, len(points))), np.zeros(len(points))
    per_cell = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far"), F.sum(F.col("is_query").cast("int")).alias("queries"))
    for r in per_cell.collect():  # at most ``pivots`` rows
        summary[:, r["cell"]], asked[r["cell"]] = (r["n"], r["far"] * (1 + 1e-9)), r["queries"]
    blocks = [max(1, -(-int(n) // BLOCK_ROWS)) for n in summary[0]]
    layout = spark.createDataFrame([(c, n, *q) for c, (n, q) in enumerate(zip(blocks, query_blocks(points, asked), strict=True))], "cell int, blocks int, first_block int, parts int")
    layout = F.broadcast(layout)  # at most ``pivots`` rows
    queries = celled.where("is_query").join(layout, "cell").select("uid", "vec_id", "vec", (F.col("first_block") + _part(F.col("uid"), F.col("parts"))).alias("query_block"))
    data = celled.join(_wanted(queries, points, summary, k), "cell").join(layout, "cell")
    data = data.select("uid", "vec_id", "vec", "cell", _part(F.col("uid"), F.col("blocks")).alias("block"), F.explode("query_blocks").alias("query_block"))
    targets = _targets(queries, points, summary, k).join(layout.select("cell", "blocks"), "cell")
    return data, targets.select("uid", "vec_id", "vec", "cell", "floor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_block")


def exact_top_k(embeddings: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every query.

    Vectors are floor(256 x).  Queries are the rows whose vec_id is divisible
    by 50; candidates are all rows but the query's own.  Ties go to the smaller
    vec_id (null last).  Null vectors and vectors with null or non-finite
    components take no part; shorter vectors count as filled up with zeros.
    Repeated rows are rows of their own, so a repeated query is answered twice.
    Components so large that an inner product might not fit a long are refused
    with an error.  Fewer than k candidates are all returned; an empty
    table gives an empty result.  Other columns are ignored.
    """
    data, asked = placed(embeddings, k, pivots)
    keys = ["cell", "block", "query_block"]
    best = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_solve(k), "query_uid long, query_id long, uid long, vec_id long, score long")
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
