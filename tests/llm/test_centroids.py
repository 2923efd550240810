import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from braidmill.llm import centroids as C

from .helpers import same

COLUMNS = "vec_id long, embedding array<{}>, label int, cluster string, vector int, times int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "c", 0, 2) for i, v in rows], COLUMNS.format(kind))


def plain(rows, k, rounds, width, scale, single=True):
    """Lloyd's rounds over all rows, one by one."""
    number = (lambda x: float(np.float32(x))) if single else float
    kept = [(i, [math.floor(Fraction(number(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{C.SEED}:{i}".encode()).hexdigest(), C._packed(v), v) for i, v in kept if i is not None)
    centers = [v for _, _, v in first[:k]]
    if not centers:
        return []
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centers)), key=lambda j: (away(v, centers[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        centers = [[sum(x) // of.count(j) for x in zip(*(v for (_, v), o in zip(kept, of, strict=True) if o == j), strict=True)] if j in of else c for j, c in enumerate(centers)]
    out = [(i, nearest(v), v) for i, v in kept]
    inertia = Counter()
    for _, j, v in out:
        inertia[j] += away(v, centers[j])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, j, away(v, centers[j]), inertia[j], sum(inertia.values()), digest[j]) for i, j, v in out]


def test_clusters_by_brute_force(spark):
    rng = random.Random(5)
    vec = lambda middle: [rng.gauss(middle, 0.2) for _ in range(6)]
    hot = vec(0)
    rows = [(i, hot if i % 3 == 0 else vec(i % 4)) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, vec(1)), (None, hot)]  # ids again, and without
    rows += [(900, None), (901, []), (902, hot[:5]), (903, [*hot, 0.0]), (904, [None, *hot[1:]]), (905, [float("nan"), *hot[1:]]), (906, [float("-inf"), *hot[1:]])]
    for k, rounds in ((8, 10), (3, 1), (1, 2), (8, 0)):
        got = C.centroid_clusters(table(spark, rows), k, rounds, 6)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        same(got.collect(), plain(rows, k, rounds, 6, C.SCALE))


def test_few_rows_ties_and_empty_centroids(spark):
    a, b = [0.5, 0.25], [-0.5, 1.0]
    for rows in ([(1, a), (2, a), (3, a), (4, b)], [(1, a)], [(1, a), (1, a), (1, b)], [(5, [0.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0])]):
        got = C.centroid_clusters(table(spark, rows), 3, 4, 2).collect()
        same(got, plain(rows, 3, 4, 2, C.SCALE))
    assert C.centroid_clusters(table(spark, []), 3, 4, 2).collect() == []
    assert C.centroid_clusters(table(spark, [(1, None), (2, a)]), 3, 4, 64).collect() == []
    assert C.centroid_clusters(table(spark, [(None, a)]), 3, 4, 2).collect() == []


def test_large_components_are_exact(spark):
    """Components beyond int32 and beyond exact floating-point products; what fits no long is an error."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e3, 9e5), rng.gauss(0, 1)]) for i in range(40)] + [(50 + i, [2.0**21 + 0.001 * i, 0.0]) for i in range(3)]
    got = C.centroid_clusters(table(spark, rows, "double"), 4, 5, 2).collect()
    want = plain(rows, 4, 5, 2, C.SCALE, single=False)
    same(got, want)
    assert max(r[2] for r in want) > 2**53
    # equal vectors lie on their centroid, however large
    far = [(1, [1.7e308, 3e-300]), (2, [1.7e308, 3e-300])]
    assert [tuple(r)[2:5] for r in C.centroid_clusters(table(spark, far, "double"), 1, 2, 2).collect()] == [(0, 0, 0)] * 2
    with pytest.raises(Exception, match="does not fit a long"):
        C.centroid_clusters(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])], "double"), 1, 2, 2).collect()


def test_sums_come_in_parts(spark):
    for value in (0, 1, -1, 2**40, -(2**40) - 1, 2**200 + 12345, -(2**200)):
        parts = C._limbs(value)
        assert sum(v << C._LIMB * i for i, v in enumerate(parts)) == value and all(abs(v) <= 2**C._LIMB for v in parts)
