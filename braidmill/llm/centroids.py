"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with multiplicities.

1. Vectors are quantised to integers and packed; equal ones are grouped, so
   that a vector that half the rows share is one row with a count (counts are
   added up before they are shuffled).
2. Each round is one pass over the distinct vectors: tasks assign them to the
   nearest centroid and send weighted integer sums, a row for each centroid and
   component; the driver gets these sums only, ``k`` times the width of them.
3. The last assignment is written, and joined back to the vec_ids by vector.

All arithmetic is exact: distances are taken as floating-point products where
these cannot round, and as Python integers where components are too large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textops import release_memory

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components up to here have exact squared distances in floating-point numbers at this module's widths.
_EXACT = 1 << 21
_NARROW = 1 << 31
#: Bits of the parts in which tasks send their sums; four million tasks' parts fit a long.
_LIMB = 40
#: Vectors whose distances are taken at once.
_BLOCK = 4096


def is_kept(x: Column, width: int) -> Column:
    """Exactly ``width`` components, none null, NaN or infinite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce((F.size(x) == width) & ~bad, F.lit(False))


def _packed(values: list[int]) -> bytes:
    """One byte for the kind, then int32 numbers or, where one is too large for these, decimals."""
    if all(-_NARROW <= v < _NARROW for v in values):
        return b"i" + np.array(values, "<i4").tobytes()
    return b"t" + ",".join(map(str, values)).encode()


def _unpacked(key: bytes) -> list[int]:
    return np.frombuffer(key, "<i4", offset=1).tolist() if key[:1] == b"i" else [int(v) for v in key[1:].decode().split(",")]


def packed_vectors(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector binary): the kept vectors, each component floor(scale * x)."""
    rows = embeddings.where(is_kept(F.col("embedding"), width)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            with np.errstate(over="ignore"):
                x = np.floor(given * scale)  # a power of two times a double rounds nothing
            narrow = (np.abs(x) < _NARROW).all(1)
            wide = {i: _packed([math.floor(Fraction(v) * scale) for v in given[i].tolist()]) for i in np.flatnonzero(~narrow).tolist()}
            ints = np.where(narrow[:, None], x, 0).astype("<i4")
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([wide.get(i) or b"i" + r.tobytes() for i, r in enumerate(ints)], pa.binary())], names=["vec_id", "vector"])

    return rows.mapInArrow(pack, "vec_id long, vector binary")


def _matrix(keys: list[bytes], width: int) -> np.ndarray:
    """int64 rows, or rows of Python integers where one vector is wide."""
    if all(k[:1] == b"i" for k in keys):
        return np.frombuffer(b"".join(k[1:] for k in keys), "<i4").reshape(len(keys), width).astype(np.int64)
    return np.array([_unpacked(k) for k in keys], dtype=object).reshape(len(keys), width)


def _nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Number of the nearest centroid (the smaller of equally near ones) and the squared distance."""
    c = np.array(centroids, dtype=object)
    if x.dtype != object and max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) < _EXACT:
        f = c.astype(np.float64)
        away = np.stack([((x - v) ** 2).sum(1) for v in f])  # below 2**53 for up to 512 components
        best = away.argmin(0)
        return best, away[best, np.arange(len(x))].astype(np.int64).tolist()
    away = [[sum((int(a) - b) ** 2 for a, b in zip(row, v, strict=True)) for v in centroids] for row in x.tolist()]
    return np.array([min(range(len(a)), key=lambda j: (a[j], j)) for a in away], np.int64), [min(a) for a in away]


def _first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select("vector", digest.alias("digest")).orderBy("digest", "vector").limit(k)
    return [_unpacked(bytes(r["vector"])) for r in sorted(first.collect(), key=lambda r: (r["digest"], bytes(r["vector"])))]


def _limbs(value: int) -> list[int]:
    """Numbers of ``_LIMB`` bits, the lowest first, the last with the sign: those of many tasks add up in longs."""
    out = []
    while not -(1 << _LIMB) <= value < 1 << _LIMB:
        out.append(value & (1 << _LIMB) - 1)
        value >>= _LIMB
    return [*out, value]


def _round(distinct: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after one round: weighted means of what is nearest, rounded down."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width + 1) for _ in centroids]
        for b in batches:
            for lo in range(0, len(b), _BLOCK):
                part = b.slice(lo, _BLOCK)
                x, n = _matrix(part["vector"].to_pylist(), width), part["times"].to_numpy()
                cluster, _ = _nearest(x, centroids)
                for j in np.unique(cluster).tolist():
                    own, times = x[cluster == j], n[cluster == j]
                    small = own.dtype != object and int(times.sum()) * _NARROW < 1 << 62
                    weighted = (own * times[:, None]).sum(0).tolist() if small else (own.astype(object) * times.astype(object)[:, None]).sum(0).tolist()
                    total[j] = [a + int(v) for a, v in zip(total[j], [int(times.sum()), *weighted], strict=True)]
        rows = [(j, d, at, v) for j, t in enumerate(total) if t[0] for d, whole in enumerate(t) for at, v in enumerate(_limbs(whole))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["cluster", "place", "limb", "value"])

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    out = list(centroids)
    parts = distinct.select("vector", "times").mapInArrow(sums, "cluster int, place int, limb int, value long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():  # clusters times components
        found.setdefault(r["cluster"], [0] * (width + 1))[r["place"]] += r["value"] << _LIMB * r["limb"]
    for j, t in found.items():
        out[j] = [t[d] // t[0] for d in range(1, width + 1)]
    return out


def fit_centroids(vectors: DataFrame, distinct: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> list[list[int]]:
    """The centroids after all rounds over ``distinct(vector, times)``; fewer than ``k`` where there are fewer rows of ``vectors``."""
    centroids = _first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids, before = _round(distinct, centroids, width), centroids
        if centroids == before:  # further rounds change nothing
            break
    return centroids


def centroid_clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``embeddings(vec_id, embedding)``.

    Kept are vectors of exactly ``width`` components, none of them null, NaN or
    infinite; all others, null vectors among them, are in no result.  Repeated
    rows count each.  A null vec_id takes part but is no first centroid (its
    row is null in the result).  Of rows with one vec_id the smaller packed
    vector comes first.  Fewer kept rows than ``k`` give as many centroids;
    equal centroids leave the later one empty; an empty table gives an empty
    result, and so does one with null ids only.  Sums and distances are exact
    whatever their size; one that does not fit a long is an error.  Other
    columns are ignored.
    """
    rows = packed_vectors(embeddings, width, scale)
    distinct = materialize(rows.groupBy("vector").agg(F.count("*").alias("times")))
    centroids = fit_centroids(rows, distinct, k, rounds, width, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b) if centroids else 0, _BLOCK):
                part = b.slice(lo, _BLOCK)
                cluster, away = _nearest(_matrix(part["vector"].to_pylist(), width), centroids)
                if max(away) >= 1 << 63:
                    raise OverflowError(f"a squared distance of {max(away)} does not fit a long; scale the vectors down")
                yield pa.RecordBatch.from_arrays([part["vector"], part["times"], pa.array(cluster.astype(np.int32)), pa.array(away, pa.int64())], names=["vector", "times", "cluster", "distance"])
            release_memory()

    nearest = materialize(distinct.select("vector", "times").mapInArrow(assign, "vector binary, times long, cluster int, distance long"))
    spent = nearest.groupBy("cluster").agg(F.sum(F.col("times") * F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)").alias("spent")).collect()  # a row for each cluster
    total = sum(int(r["spent"]) for r in spent)
    if total >= 1 << 63:
        raise OverflowError(f"an inertia of {total} does not fit a long; scale the vectors down")
    about = [(r["cluster"], int(r["spent"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in spent]
    clusters = embeddings.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(nearest.select("vector", "cluster", "distance"), "vector")
    return out.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
