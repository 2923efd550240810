"""The workflow end to end: read pairs to the final set of variant sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmill.operators import cover, graph, kmers, likelihood, pairs
from braidmill.session import materialize


def condense(read_pairs: DataFrame, k: int = 55, edge_threshold: int = 0, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """kmers, edges, unitigs and cond_edges of the workflow; ``own`` has the counts at k."""
    reads = read_pairs.select(F.explode(F.array("r1", "r2")).alias("seq"), *[c for c in read_pairs.columns if c == "times"])
    both = materialize(kmers.count_kmers_multi(reads, [k + 1, k]) if counts is None else counts)
    own, longer = both.where(F.col("k") == k), both.where(F.col("k") == k + 1)
    edges = materialize(graph.edges_from_k1mers(longer, own, k, edge_threshold))
    unitigs, cond = graph.unitigs(edges, k)
    return {"kmers": both, "own": own, "edges": edges, "unitigs": unitigs, "cond_edges": cond}


def candidates(
    read_pairs: DataFrame,
    k: int = 55,
    beam: int = 15,
    insert: int = 400,
    edge_threshold: int = 0,
    pair_threshold: int = 5,
    store: int = 1,
    counts: DataFrame | None = None,
    normalized: bool = False,
    tip_coverage: float = 0.0,
    prune_all: bool = False,
    least_support: int = 0,
) -> dict[str, DataFrame]:
    """The tables before the elimination: ``cover`` has the paths as chosen, ``paths`` those with names, ``oriented`` the support to judge them by.

    The graph is edited before the cover: tips (with ``prune_all`` all vertices)
    of a mean coverage below ``tip_coverage`` go, and support between vertices
    counts only above ``least_support``.  Depths are those of the whole graph.
    ``supported_edges`` are the k-mer edges that the kept support leaves for
    another run.
    """
    read_pairs = materialize(pairs.counted_pairs(read_pairs))  # all pairs are read once
    out = condense(read_pairs, k, edge_threshold, counts)
    own, unitigs, cond = out["own"], out["unitigs"], out["cond_edges"]
    closed = materialize(kmers.with_complements(own))  # a strand that was not read has the other's counts
    depth = materialize(cover.vertex_depths(unitigs, cond, k, closed))
    if tip_coverage > 0:
        unitigs, cond = graph.prune(unitigs, cond, graph.unitig_coverage(unitigs, closed, k), tip_coverage, prune_all)
        unitigs, cond = materialize(unitigs), materialize(cond)
        depth = materialize(depth.join(unitigs.select("vid"), "vid", "left_semi"))
        out |= {"unitigs": unitigs, "cond_edges": cond}
    places = materialize(graph.kmer_vertices(unitigs, k).join(depth, "vid").select("kmer", "vid", (F.col("depth") + F.col("offset")).alias("depth")))
    support = materialize(pairs.pair_support(read_pairs, own, k, pair_threshold, store))
    compat = pairs.compatible_set(support, places)
    compat = materialize(pairs.filter_compatible(compat, least_support) if least_support > 0 else compat)
    bubbles = pairs.bubble_vertices(depth.select("vid", "depth"), cond)
    bubble = materialize(pairs.bubble_set(support, places, bubbles, cond))
    paths = materialize(cover.cover_paths(unitigs, cond, depth, compat, bubble, k, beam, insert, normalized))
    named = paths.select(F.concat_ws(".", F.abs("component").cast("string"), "path_id").alias("path_id"), "score", "nodes", "seq", "len")
    with_depths = compat.join(depth.select(F.col("vid").alias("v1"), F.col("last_depth").alias("d1")), "v1").join(depth.select(F.col("vid").alias("v2"), F.col("depth").alias("d2")), "v2")
    oriented = materialize(likelihood.oriented(with_depths, unitigs.select("vid", "len")))
    supported = pairs.edges_with_support(out["edges"], places, compat)
    return out | {"depth": depth, "supported_edges": supported, "pairs": support, "compat": compat, "bubble": bubble, "cover": paths, "paths": named, "oriented": oriented}


def reconstruct(read_pairs: DataFrame, k: int = 55, genome: int = 1200, penalty: str = "weighted", strict: bool = False, **options) -> dict[str, DataFrame]:
    """All tables of the workflow by name; ``final`` has the chosen sequences.

    ``options`` are those of ``candidates``; its ``counts`` (k, kmer, cnt), with
    k and k + 1, replaces the workflow's own counting.  Tables that later steps
    read again are written to the shared folder.
    """
    out = candidates(read_pairs, k, **options)
    trace = likelihood.elimination(out["paths"], out["oriented"], genome, penalty)
    final = likelihood.final_set(trace, out["paths"], strict)
    return out | {"trace": trace, "final": final.select("path_id", "score", "seq", "len")}
