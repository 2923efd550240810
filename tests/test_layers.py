"""Layers, depths and the layered cover against walks of the whole graph."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidmill.operators import beam, cover, graph, layers

K = 5


def random_graph(seed, n, share, k=K):
    """A random acyclic graph with support, as the plain graph and as rows."""
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n)
    g = cover.Graph(k)
    for i, v in enumerate(ids):
        g.length[v], g.priority[v], g.first[v] = k + rng.randrange(4), float(rng.randrange(3)), f"{i:04d}"
    for i, v in enumerate(ids):
        for w in ids[i + 1 : i + 1 + n // 2]:
            if rng.random() < share:
                g.out[v].append(w)
                g.into[w].append(v)
    for side in (g.out, g.into):
        for v in side:
            side[v] = sorted(side[v])
    for i, v in enumerate(ids):
        for w in ids[i:]:
            if rng.random() < 0.6:
                g.support[v, w] = float(rng.randrange(1, 9))
                if rng.random() < 0.4:
                    g.bubble.add((v, w))
    return g


def tables(spark, g):
    vertices = spark.createDataFrame([(v, g.length[v], g.priority[v], g.first[v]) for v in g.length], "vid long, len int, cnt double, kmer string")
    edges = spark.createDataFrame([(v, w) for v in g.out for w in g.out[v]], "src long, dst long")
    support = spark.createDataFrame([(v, w, int(c)) for (v, w), c in g.support.items()], "v1 long, v2 long, cnt long")
    bubble = spark.createDataFrame(sorted(g.bubble), "v1 long, v2 long")
    return vertices, edges, support, bubble


def plain_layers(g):
    out = {}
    for v in cover.topological(g):
        out[v] = max((out[u] + 1 for u in g.into.get(v, [])), default=0)
    return out


@pytest.mark.parametrize("by_joins", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_layers_and_path_counts(spark, monkeypatch, seed, by_joins):
    if by_joins:
        monkeypatch.setattr(layers, "DRIVER_EDGES", 0)
    g = random_graph(seed, 25, 0.2)
    vertices, edges, _, _ = tables(spark, g)
    placed = layers.topological_layers(vertices, edges.unionByName(edges))  # repeated edges count once
    assert {r.vid: r.layer for r in placed.collect()} == plain_layers(g)
    labels = vertices.select("vid", F.lit(1).alias("component"))
    assert int(layers.path_totals(placed, edges, labels).first().n_paths) == cover.path_total(g)


def test_a_cycle_is_an_error_and_no_graph_gives_nothing(spark, monkeypatch):
    vertices = spark.createDataFrame([(v,) for v in range(6)], "vid long")
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3)], "src long, dst long")
    for most in (layers.DRIVER_EDGES, 0):
        monkeypatch.setattr(layers, "DRIVER_EDGES", most)
        with pytest.raises(ValueError, match="cycle: 3 vertices"):
            layers.topological_layers(vertices, ring)
        assert layers.topological_layers(vertices.limit(0), ring.limit(0)).collect() == []
        assert {r.layer for r in layers.topological_layers(vertices, ring.limit(0)).collect()} == {0}
    none = layers.topological_layers(vertices.limit(0), ring.limit(0))
    assert layers.ways(none, ring.limit(0)).collect() == []


def test_path_counts_beyond_long(spark):
    """Sixty-five diamonds in a row: 2 ** 65 ways."""
    edges = [(3 * i + a, 3 * i + b) for i in range(65) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    vertices = spark.createDataFrame([(v,) for v in range(196)], "vid long")
    cond = spark.createDataFrame(edges, "src long, dst long")
    by_driver = layers.topological_layers(vertices, cond)
    assert by_driver.agg(F.max("layer")).first()[0] == 130
    short = cond.where("dst <= 9")  # a few layers are enough for the sums
    placed = layers.topological_layers(vertices.where("vid <= 9"), short)
    assert int(layers.ways(placed, short).where("vid = 9").first().n) == 8
    huge = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    start = layers.topological_layers(vertices.where("vid <= 2"), huge)
    assert [int(r.n) for r in layers.ways(start, huge).collect()] == [1, 1, 1]


@pytest.mark.parametrize("seed, given", [(3, False), (4, True), (5, False)])
def test_depths_are_those_of_a_depth_first_walk(spark, seed, given):
    g = random_graph(seed, 40, 0.15)
    start = None
    if given:
        chosen = g.sources()[-1::-2]
        g.start = {v: i for i, v in enumerate(chosen)}
        start = spark.createDataFrame(list(g.start.items()), "vid long, ord int")
    cover.assign_depths(g)
    vertices, edges, _, _ = tables(spark, g)
    got = layers.depth_first(layers.topological_layers(vertices, edges), vertices, edges, K, start)
    assert {r.vid: (r.depth, r.root) for r in got.collect()} == {v: (d, g.root[v]) for v, d in g.depth.items()}


def with_depths(spark, g):
    cover.assign_depths(g)
    vertices, edges, support, bubble = tables(spark, g)
    depth = spark.createDataFrame(list(g.depth.items()), "vid long, depth int")
    return layers.topological_layers(vertices, edges).join(depth, "vid"), edges, support, bubble


@pytest.mark.parametrize("seed, normalized, width, insert", [(6, False, 3, 6), (7, True, 2, 4), (8, False, 15, 100), (9, False, 2, 8)])
def test_cover_equals_the_walk(spark, seed, normalized, width, insert):
    g = random_graph(seed, 14, 0.35)
    placed, edges, support, bubble = with_depths(spark, g)
    plain = cover.Cover(g, width, insert, normalized)
    weighted = beam.weighted_support(support, bubble, normalized)
    for backward, want in ((True, plain.back), (False, plain.ahead)):
        got = defaultdict(list)
        for r in sorted(beam.sub_paths(placed, edges, weighted, width, insert, normalized, backward).collect(), key=lambda r: (r.vid, r["rank"])):
            got[r.vid].append((list(r.nodes), r.score))
        assert dict(got) == {v: [(p, s) for p, s in kept] for v, kept in want.items() if kept}
    chosen = beam.layered_cover(placed, edges, support, bubble, width, insert, normalized, -100.0)
    rows = chosen.collect()
    assert sorted((tuple(r.nodes), r.score) for r in rows) == sorted((tuple(p), s) for s, p in plain.chosen())
    assert len({r.path_id for r in rows}) == len(rows)


def test_candidates_worth_nothing_must_support_something_new(spark):
    """Zero scores: kept by what they support anew, in the order of their nodes."""
    rows = [(1, 0, [5], [], True), (1, 0, [6, 7], [7], False), (1, 0, [6, 8], [7], False), (1, 0, [6, 9], [9, 7], False), (1, 0, [7, 1], [], False)]
    frame = spark.createDataFrame([(v, d, n, [0] * len(n), h) for v, d, n, h, _ in rows], "vid long, depth int, nodes array<long>, depths array<long>, held array<long>")
    got = sorted((r["rank"], list(r.nodes)) for r in beam._fresh_only(frame, 9).collect())
    assert got == [(0, [5]), (1, [6, 7]), (2, [6, 9])]
    assert [list(r.nodes) for r in beam._fresh_only(frame, 1).collect()] == [[5]]


@pytest.mark.parametrize("by_joins", [False, True])
def test_turns_in_rounds_equal_turns_one_by_one(spark, monkeypatch, by_joins):
    if by_joins:
        monkeypatch.setattr(beam, "DRIVER_EDGES", 0)
    rng = random.Random(11)
    order = [(v, rng.randrange(12)) for v in range(60)]
    covers = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)]
    used, want = set(), set()
    for v, _ in sorted(order, key=lambda x: (-x[1], x[0])):
        if v not in used:
            want.add(v)
            used |= {b for a, b in covers if a == v}
    got = beam.first_uncovered(spark.createDataFrame(order, "vid long, depth int"), spark.createDataFrame(covers, "vid long, other long"))
    assert {r.vid for r in got.collect()} == want


def test_a_graph_without_support_and_an_empty_one(spark):
    g = random_graph(12, 8, 0.4)
    g.support, g.bubble = {(next(iter(g.length)), next(iter(g.length))): 1.0}, set()
    placed, edges, support, bubble = with_depths(spark, g)
    plain = cover.Cover(g, 3, 4, False)
    g.support.clear()
    plain = cover.Cover(g, 3, 4, False)
    none = bubble.limit(0) if g.bubble else spark.createDataFrame([], "v1 long, v2 long")
    rows = beam.layered_cover(placed, edges, support.limit(0), none, 3, 4, False, -100.0).collect()
    assert sorted((tuple(r.nodes), r.score) for r in rows) == sorted((tuple(p), s) for s, p in plain.chosen())
    assert beam.layered_cover(placed.limit(0), edges.limit(0), support.limit(0), none).collect() == []
    assert graph.vertex_sources(placed, edges).count() > 0


@pytest.mark.parametrize("seed, normalized", [(21, False), (22, True)])
def test_large_graphs_give_the_rows_of_small_ones(spark, monkeypatch, seed, normalized):
    """Depths, path counts and covers with sequences, walked by tasks and layer by layer."""
    g = random_graph(seed, 12, 0.3)
    rng = random.Random(seed)
    seq = {v: "".join(rng.choice("ACGT") for _ in range(g.length[v])) for v in g.length}
    unitigs = spark.createDataFrame([(v, s) for v, s in seq.items()], "vid long, seq string")
    _, edges, support, bubble = tables(spark, g)
    kmers = spark.createDataFrame([(s[:K], int(g.priority[v])) for v, s in seq.items() if g.priority[v]], "kmer string, cnt long")
    bubble = bubble.withColumn("cnt", F.lit(1).cast("long"))
    order = spark.createDataFrame([(seq[v][:K], i) for i, v in enumerate(g.sources()[::-1])], "kmer string, ord int")

    def every():
        depth = cover.vertex_depths(unitigs, edges, K, kmers)
        paths = cover.cover_paths(unitigs, edges, depth, support, bubble, K, 3, 6, normalized)
        return [sorted(map(repr, df.collect())) for df in (depth, cover.vertex_depths(unitigs, edges, K, kmers, order), cover.path_counts(unitigs, edges, K), paths)]

    want = every()
    monkeypatch.setattr(cover, "SMALL_EDGES", 0)
    assert every() == want and len(want[3]) > 3
