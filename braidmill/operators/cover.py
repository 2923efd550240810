"""Paths through the contracted graph: depths, path counts and the bounded best-path cover.

Graphs of up to ``SMALL_EDGES`` edges and ``SMALL_SUPPORT`` supported pairs, which
are counted first, are walked component by component, each in one task.  All
larger ones go layer by layer (``layers``, ``beam``) and give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmill.session import materialize

from . import beam as layered
from . import layers
from .components import connected_components

#: Of a graph that tasks walk; larger ones go layer by layer.
SMALL_EDGES, SMALL_SUPPORT = 20_000, 500_000

_ROW = "component long, kind string, a long, b long, x double, s string"


@dataclass
class Graph:
    """One component. depth counts a vertex's first k-mer; support and bubble are keyed (v1, v2)."""

    k: int
    length: dict = field(default_factory=dict)
    first: dict = field(default_factory=dict)
    priority: dict = field(default_factory=dict)
    out: dict = field(default_factory=lambda: defaultdict(list))
    into: dict = field(default_factory=lambda: defaultdict(list))
    depth: dict = field(default_factory=dict)
    root: dict = field(default_factory=dict)
    support: dict = field(default_factory=dict)
    bubble: set = field(default_factory=set)
    start: dict = field(default_factory=dict)

    def sources(self) -> list[int]:
        return sorted(v for v in self.length if not self.into.get(v))

    def sinks(self) -> list[int]:
        return sorted(v for v in self.length if not self.out.get(v))


def _graph(rows: pd.DataFrame, k: int) -> Graph:
    g = Graph(k)
    for r in rows.itertuples(index=False):
        if r.kind == "vertex":
            g.length[r.a], g.priority[r.a], g.first[r.a] = int(r.b), float(r.x), r.s
        elif r.kind == "edge":
            g.out[r.a].append(r.b)
            g.into[r.b].append(r.a)
        elif r.kind == "depth":
            g.depth[r.a] = int(r.b)
        elif r.kind == "support":
            g.support[r.a, r.b] = float(r.x)
        elif r.kind == "start":
            g.start[r.a] = int(r.b)
        elif r.kind == "bubble":
            g.bubble.add((r.a, r.b))
    for side in (g.out, g.into):
        for v in side:
            side[v] = sorted(set(side[v]))
    return g


def assign_depths(g: Graph) -> None:
    """Depth-first from the most frequent source on; children by frequency, ties by k-mer.

    Sources with a given start come first, in that order.  A vertex keeps the
    depth and root of its first visit.
    """
    order = lambda vs: sorted(vs, key=lambda v: (-g.priority[v], g.first[v]))
    given = sorted((s for s in g.sources() if s in g.start), key=g.start.get)
    for source in [*given, *(s for s in order(g.sources()) if s not in g.start)]:
        if source in g.depth:
            continue
        g.depth[source], g.root[source] = 0, source
        stack = [iter(order(g.out.get(source, [])))]
        trail = [source]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                trail.pop()
            elif child not in g.depth:
                parent = trail[-1]
                g.depth[child] = g.depth[parent] + g.length[parent] - g.k + 1
                g.root[child] = source
                stack.append(iter(order(g.out.get(child, []))))
                trail.append(child)


def topological(g: Graph) -> list[int]:
    """Vertices so that edges point forward; raises on a cycle."""
    missing = {v: len(g.into.get(v, [])) for v in g.length}
    ready = sorted(v for v, n in missing.items() if n == 0)
    out = []
    while ready:
        v = ready.pop()
        out.append(v)
        for w in g.out.get(v, []):
            missing[w] -= 1
            if missing[w] == 0:
                ready.append(w)
    if len(out) < len(g.length):
        raise ValueError(f"the graph has a cycle through {len(g.length) - len(out)} vertices")
    return out


def path_total(g: Graph) -> int:
    """Number of ways from a source to a sink."""
    ways: dict[int, int] = {}
    for v in reversed(topological(g)):
        after = g.out.get(v, [])
        ways[v] = sum(ways[w] for w in after) if after else 1
    return sum(ways[v] for v in g.sources())


class Cover:
    """Best sub-paths of every vertex, to the sinks and from the sources, and the chosen cover."""

    def __init__(self, g: Graph, beam: int, insert: int, normalized: bool):
        self.g, self.beam, self.insert, self.normalized = g, beam, insert, normalized
        partners: dict[int, float] = defaultdict(float)
        for (v, _), c in g.support.items():
            partners[v] += c if normalized else 1
        self.weight = {(v, w): c / partners[v] for (v, w), c in g.support.items()}
        self.order = topological(g)
        self.back = self._backward()
        self.ahead = self._forward()

    def _gain(self, near: bool, pair: tuple[int, int], c: int, backward: bool) -> float:
        supported, bubble = pair in self.g.support, pair in self.g.bubble
        share = self.weight.get(pair, 0.0)
        if not supported:
            return -float(c) if near else 0.01
        if near:
            full, single = 2.0, share if backward and not self.normalized else 1.0
        else:
            full, single = 1.0, 0.5
        return (full if bubble else single) * (share if self.normalized else 1.0)

    def _backward(self) -> dict[int, list[tuple[list[int], float]]]:
        g, kept = self.g, {}
        for s in reversed(self.order):
            scored = []
            for after in g.out.get(s, []):
                for path, score in kept[after]:
                    c = len(path)
                    total = score if c == 1 else score * c * (c - 1) / 2
                    for n in path:
                        total += self._gain(g.depth[n] - g.depth[s] < self.insert, (s, n), c, True)
                    scored.append((2 * total / (c * (c + 1)) if c > 1 else total, path))
            scored.sort(key=lambda x: (-x[0], x[1]))
            best = scored[0][0] if scored else 0.0
            chosen, covered = [], set()
            for value, path in scored:
                if len(chosen) >= self.beam or value < 0.25 * best:
                    break
                fresh = {n for n in path if (s, n) in g.support and n not in covered}
                if fresh or value > 0 or len(path) < 2:
                    covered |= fresh
                    chosen.append(([s, *path], value / best if best else value))
            kept[s] = chosen or [([s], 0.0)]
        return kept

    def _forward(self) -> dict[int, list[tuple[list[int], float]]]:
        g, kept = self.g, {}
        for s in self.order:
            scored = []
            for before in g.into.get(s, []):
                for path, score in kept[before]:
                    c = len(path) + 1
                    total = score * c * (c - 1) / 2
                    for n in path:
                        total += self._gain(g.depth[s] - g.depth[n] < self.insert, (n, s), c, False)
                    scored.append((min(1.0, 2 * total / (c * (c + 1))), path))
            scored.sort(key=lambda x: (-x[0], x[1]))
            best = scored[0][0] if scored else 0.0
            kept[s] = [([*path, s], value / best if best else value) for value, path in scored[: self.beam] if value >= 0.25 * best]
            if not g.into.get(s):
                kept[s] = [([s], 0.0)]
        return kept

    def chosen(self, each: int = 10) -> list[tuple[float, list[int]]]:
        return [(score, path) for _, score, path in self.named(each)]

    def named(self, each: int = 10) -> list[tuple[str, float, list[int]]]:
        """All paths of the sources, then for every vertex left out the best ways through it; named by vertex, head and tail."""
        g = self.g
        out: list[tuple[str, float, list[int]]] = []
        have: set[tuple] = set()
        for s in sorted(g.sources(), key=lambda v: (g.depth[v], v)):
            for tail, (path, score) in enumerate(self.back[s]):
                if tuple(path) not in have:
                    have.add(tuple(path))
                    out.append((f"{s}.0.{tail}", score, path))
        used = {n for _, _, p in out for n in p}
        for v in sorted(g.length, key=lambda v: (-g.depth[v], v)):
            if v in used:
                continue
            for i, (head, up) in enumerate(self.ahead[v][:each]):
                for j, (tail, down) in enumerate(self.back[v][:each]):
                    path = head + tail[1:]
                    if len(path) > 1 and not any(_inside(path, p) for _, _, p in out):
                        out.append((f"{v}.{i}.{j}", up + down, path))
                        used.update(path)
        return out


def _inside(part: list[int], whole: list[int]) -> bool:
    n = len(part)
    return any(whole[i : i + n] == part for i in range(len(whole) - n + 1))


def _small(cond: DataFrame, support: DataFrame | None = None) -> bool:
    few = cond.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES
    return few and (support is None or support.limit(SMALL_SUPPORT + 1).count() <= SMALL_SUPPORT)


def _labels(unitigs: DataFrame, cond: DataFrame) -> DataFrame:
    """(vid, component): the smallest vertex that a vertex is connected with."""
    labels = connected_components(cond.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "vid")
    return unitigs.select("vid").join(labels, "vid", "left").select("vid", F.coalesce("label", "vid").alias("component"))


def _rows(unitigs: DataFrame, cond: DataFrame, coverage: DataFrame | None, depth: DataFrame | None, support: DataFrame | None, bubble: DataFrame | None, start: DataFrame | None = None) -> DataFrame:
    edges = cond.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    labels = _labels(unitigs, cond)
    none = F.lit(None)
    priority = unitigs.select("vid", F.lit(0.0).alias("x")) if coverage is None else coverage.select("vid", F.col("cnt").cast("double").alias("x"))
    parts = [unitigs.join(priority, "vid", "left").select(F.lit("vertex").alias("kind"), F.col("vid").alias("a"), F.length("seq").cast("long").alias("b"), F.coalesce("x", F.lit(0.0)).alias("x"), F.col("seq").alias("s"))]
    parts.append(edges.select(F.lit("edge").alias("kind"), "a", "b", none.cast("double").alias("x"), none.cast("string").alias("s")))
    if depth is not None:
        parts.append(depth.select(F.lit("depth").alias("kind"), F.col("vid").alias("a"), F.col("depth").cast("long").alias("b"), none.cast("double").alias("x"), none.cast("string").alias("s")))
    if start is not None:
        parts.append(start.select(F.lit("start").alias("kind"), F.col("vid").alias("a"), F.col("ord").cast("long").alias("b"), none.cast("double").alias("x"), none.cast("string").alias("s")))
    for kind, pairs in (("support", support), ("bubble", bubble)):
        if pairs is not None:
            parts.append(pairs.select(F.lit(kind).alias("kind"), F.col("v1").alias("a"), F.col("v2").alias("b"), F.col("cnt").cast("double").alias("x"), none.cast("string").alias("s")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(labels.withColumnRenamed("vid", "a"), "a").select("component", "kind", "a", "b", "x", "s")


def vertex_depths(unitigs: DataFrame, cond: DataFrame, k: int, kmers: DataFrame | None = None, start_order: DataFrame | None = None) -> DataFrame:
    """(vid, depth, last_depth, root): depth-first depths of each vertex's first and last k-mer.

    ``kmers`` gives the counts that order sources and children;
    ``start_order(kmer, ord)`` names sources to start with.  A graph too large
    for one task must have no cycle.
    """
    first = unitigs.select("vid", F.left("seq", F.lit(k)).alias("kmer"))
    counts = None if kmers is None else first.join(kmers.select("kmer", "cnt"), "kmer").select("vid", "cnt")
    start = None if start_order is None else first.join(start_order, "kmer").select("vid", "ord")
    if not _small(cond):
        rows = first.join(counts, "vid", "left") if counts is not None else first.withColumn("cnt", F.lit(0.0))
        rows = rows.select("vid", "kmer", F.coalesce("cnt", F.lit(0)).cast("double").alias("cnt")).join(unitigs.select("vid", F.length("seq").alias("len")), "vid")
        found = layers.depth_first(layers.topological_layers(unitigs, cond), rows, cond, k, start)
        last = found.join(rows.select("vid", "len"), "vid")
        return last.select("vid", "depth", (F.col("depth") + F.col("len") - k).cast("int").alias("last_depth"), "root")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        g = _graph(rows, k)
        assign_depths(g)
        return pd.DataFrame([(v, d, d + g.length[v] - k, g.root[v]) for v, d in sorted(g.depth.items())], columns=["vid", "depth", "last_depth", "root"])

    return _rows(unitigs, cond, counts, None, None, None, start).groupBy("component").applyInPandas(solve, "vid long, depth int, last_depth int, root long")


def path_counts(unitigs: DataFrame, cond: DataFrame, k: int) -> DataFrame:
    """(component, n_paths decimal(38,0)): ways from sources to sinks."""
    if not _small(cond):
        return layers.path_totals(layers.topological_layers(unitigs, cond), cond, _labels(unitigs, cond))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": [rows["component"].iloc[0]], "n_paths": [str(path_total(_graph(rows, k)))]})

    out = _rows(unitigs, cond, None, None, None, None).groupBy("component").applyInPandas(solve, "component long, n_paths string")
    return out.select("component", F.col("n_paths").cast("decimal(38,0)").alias("n_paths"))


def cover_paths(unitigs: DataFrame, cond: DataFrame, depth: DataFrame, support: DataFrame, bubble: DataFrame, k: int, beam: int = 15, insert: int = 400, normalized: bool = False, least_score: float = -10.0) -> DataFrame:
    """(component, path_id, score, nodes, depths, seq, len): the chosen paths.

    ``path_id`` has the vertex that a path was made for and the numbers of its
    way up and down.  ``depths`` are those of each vertex's last k-mer.
    ``normalized`` weighs support by its share of the vertex's summed support.
    """
    if not _small(cond, support):
        placed = layers.topological_layers(unitigs, cond).join(depth.select("vid", "depth"), "vid")
        paths = materialize(layered.layered_cover(placed, cond, support, bubble, beam, insert, normalized, least_score))
        seqs = stitch_paths(paths, unitigs, k)
        last = unitigs.join(depth, "vid").select("vid", (F.col("depth") + F.length("seq") - k).cast("int").alias("last"))
        steps = paths.select("path_id", F.posexplode("nodes").alias("pos", "vid")).join(last, "vid")
        depths = steps.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "last"))), lambda x: x["last"]).alias("depths"))
        labels = _labels(unitigs, cond).select(F.col("vid").alias("head"), "component")
        out = paths.join(seqs, "path_id").join(depths, "path_id").withColumn("head", F.col("nodes")[0]).join(labels, "head")
        return out.select("component", "path_id", "score", "nodes", "depths", "seq", "len")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        g = _graph(rows, k)
        out = []
        for name, score, path in Cover(g, beam, insert, normalized).named():
            if score >= least_score:
                seq = g.first[path[0]] + "".join(g.first[v][k - 1 :] for v in path[1:])
                out.append((rows["component"].iloc[0], name, float(score), path, [g.depth[v] + g.length[v] - k for v in path], seq, len(seq)))
        return pd.DataFrame(out, columns=["component", "path_id", "score", "nodes", "depths", "seq", "len"])

    rows = _rows(unitigs, cond, None, depth, support, bubble)
    return rows.groupBy("component").applyInPandas(solve, "component long, path_id string, score double, nodes array<long>, depths array<int>, seq string, len int")


def stitch_paths(paths: DataFrame, unitigs: DataFrame, k: int) -> DataFrame:
    """(path_id, seq, len): sequences of paths(path_id, nodes) over overlapping unitigs."""
    steps = paths.select("path_id", F.posexplode("nodes").alias("pos", "vid")).join(unitigs.select("vid", "seq"), "vid")
    piece = F.when(F.col("pos") == 0, F.col("seq")).otherwise(F.substring("seq", F.lit(k), F.length("seq")))
    rows = steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return rows.select("path_id", seq.alias("seq")).select("path_id", "seq", F.length("seq").alias("len"))
