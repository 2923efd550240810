"""python -m braidmill: run the workflow on files and write its tables and the final sequences.

``python -m braidmill STAGE ...`` runs one stage: count, edges, condense, prune,
support, sets, eliminate, final or fastg (``STAGE -h`` tells what it takes).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("braidmill").getOrCreate()


def _judged(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Paths and oriented support of a condensed graph, a support file and a paths file."""
    from braidmill.operators import likelihood
    from braidmill.sources import files

    unitigs, _ = files.read_condensed_graph(spark, a.condensed)
    compat = files.read_support_lists(spark, a.compat)
    return files.read_paths(spark, a.paths, a.whole_key).select("path_id", "nodes"), likelihood.oriented(compat, unitigs.select("vid", "len"))


def _count(spark, a):
    from braidmill.operators import kmers
    from braidmill.sources import files, sinks

    reads = files.read_sequences(spark, a.reads)
    found = kmers.count_kmers_multi(reads, a.k) if not a.canonical else None
    for k in a.k:
        one = kmers.count_canonical(reads, k) if a.canonical else found.where(F.col("k") == k)
        sinks.write_kmer_text(kmers.solid(one, a.least), f"{a.out}/{k}")


def _edges(spark, a):
    from braidmill.operators import graph
    from braidmill.sources import files, sinks

    sinks.write_edges(graph.edges_from_k1mers(files.read_kmer_counts(spark, a.k1mers), files.read_kmer_counts(spark, a.kmers), a.k, a.threshold), a.out)


def _condense(spark, a):
    from braidmill.operators import graph
    from braidmill.sources import files, sinks

    edges = graph.filter_edges(files.read_edges(spark, a.edges), files.read_kmer_counts(spark, a.kmers), a.threshold, strand_tolerant=True)
    sinks.write_condensed_graph(*graph.unitigs(edges, a.k), a.out)


def _prune(spark, a):
    from braidmill.operators import graph
    from braidmill.sources import files, sinks

    unitigs, cond = files.read_condensed_graph(spark, a.condensed)
    coverage = graph.unitig_coverage(unitigs, files.read_kmer_counts(spark, a.kmers, a.threshold, True), a.k)
    sinks.write_condensed_graph(*graph.prune(unitigs, cond, coverage, a.least, a.all), a.out)


def _support(spark, a):
    from braidmill.operators import pairs
    from braidmill.sources import files, sinks

    compat = files.read_support_lists(spark, a.compat)
    ends = compat.select(F.col("v1").alias("vid"), F.col("d1").alias("depth")).unionByName(compat.select(F.col("v2").alias("vid"), F.col("d2").alias("depth")))
    kept = pairs.filter_compatible(compat.select("v1", "v2", "cnt"), a.threshold)
    sinks.write_support_lists(kept, ends.groupBy("vid").agg(F.min("depth").alias("depth")), a.out)


def _sets(spark, a):
    from braidmill.operators import likelihood
    from braidmill.sources import files

    paths, judged = _judged(spark, a)
    likelihood.set_likelihood(files.read_candidate_sets(spark, a.sets), paths, judged, a.genome, a.penalty).orderBy("set_id").write.csv(a.out, sep=" ")


def _eliminate(spark, a):
    from braidmill.operators import likelihood
    from braidmill.sources import sinks

    paths, judged = _judged(spark, a)
    sinks.write_trace(likelihood.elimination(paths, judged, a.genome, a.penalty), a.out)


def _final(spark, a):
    from braidmill.operators import cover, likelihood
    from braidmill.sources import files, sinks

    unitigs, _ = files.read_condensed_graph(spark, a.condensed)
    stitched = cover.stitch_paths(files.read_paths(spark, a.paths, a.whole_key).select("path_id", "nodes"), unitigs, a.k)
    sinks.write_fasta(likelihood.final_set(files.read_trace(spark, a.trace), stitched, a.strict), a.out, "path_id")


def _fastg(spark, a):
    from braidmill.sources import files, sinks

    sinks.write_fastg(*files.read_condensed_graph(spark, a.condensed), a.k, a.out)


_WHERE = {"condensed": "condensed graph", "compat": "support between vertices", "paths": "paths", "kmers": "k-mer counts", "k1mers": "counts of the (k+1)-mers", "edges": "k-mer edges", "sets": "lines of path ids with commas", "trace": "trace of an elimination", "reads": "FASTA or FASTQ, or a list of such files"}
#: Of each stage: what it runs, its input files, and its other options.
STAGES = {
    "count": (_count, ["reads"], {"-k": {"type": int, "nargs": "+", "required": True}, "--least": {"type": int, "default": 1}, "--canonical": {"action": "store_true"}}),
    "edges": (_edges, ["kmers", "k1mers"], {"-k": {"type": int, "required": True}, "--threshold": {"type": int, "default": 0}}),
    "condense": (_condense, ["edges", "kmers"], {"-k": {"type": int, "required": True}, "--threshold": {"type": int, "default": 0}}),
    "prune": (_prune, ["condensed", "kmers"], {"-k": {"type": int, "required": True}, "--threshold": {"type": int, "default": 0}, "--least": {"type": float, "default": 35.0}, "--all": {"action": "store_true"}}),
    "support": (_support, ["compat"], {"--threshold": {"type": int, "default": 10}}),
    "sets": (_sets, ["condensed", "compat", "paths", "sets"], {"--genome": {"type": int, "default": 1200}, "--penalty": {"choices": ["weighted", "flat"], "default": "weighted"}, "--ids-only": {"dest": "whole_key", "action": "store_false"}}),
    "eliminate": (_eliminate, ["condensed", "compat", "paths"], {"--genome": {"type": int, "default": 1200}, "--penalty": {"choices": ["weighted", "flat"], "default": "weighted"}, "--ids-only": {"dest": "whole_key", "action": "store_false"}}),
    "final": (_final, ["condensed", "paths", "trace"], {"-k": {"type": int, "required": True}, "--strict": {"action": "store_true"}, "--ids-only": {"dest": "whole_key", "action": "store_false"}}),
    "fastg": (_fastg, ["condensed"], {"-k": {"type": int, "required": True}}),
}


def stage(args: list[str]) -> None:
    """One stage: its input files by name, its options, and the path to write."""
    run, inputs, options = STAGES[args[0]]
    p = argparse.ArgumentParser(prog=f"braidmill {args[0]}")
    for name in inputs:
        p.add_argument(f"--{name}", required=True, help=_WHERE[name])
    for flag, about in options.items():
        p.add_argument(flag, **about)
    p.add_argument("--out", required=True)
    run(_session(), p.parse_args(args[1:]))


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    if args and args[0] in STAGES:
        return stage(args)
    p = argparse.ArgumentParser(prog="braidmill", description=__doc__)
    p.add_argument("--fas", help="FASTA file in which mates follow each other")
    p.add_argument("--fas1", help="first mates (FASTA or FASTQ)")
    p.add_argument("--fas2", help="second mates, in the same order")
    p.add_argument("--counts", help="k-mer counts (text) to use instead of counting; both lengths k and k + 1")
    p.add_argument("-k", type=int, default=55)
    p.add_argument("-M", type=int, default=15, help="sub-paths kept for each vertex")
    p.add_argument("--IS", type=int, default=400, help="insert size")
    p.add_argument("--GL", type=int, default=1200, help="genome length")
    p.add_argument("--graph-threshold", type=int, default=0)
    p.add_argument("--pair-threshold", type=int, default=5)
    p.add_argument("--store", type=int, default=1)
    p.add_argument("--penalty", choices=["weighted", "flat"], default="weighted")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--tip-coverage", type=float, default=0.0, help="tips of a lower mean coverage go before the cover")
    p.add_argument("--prune-all", action="store_true", help="all vertices below the tip coverage go")
    p.add_argument("--least-support", type=int, default=0, help="support between vertices counts above it only")
    p.add_argument("--normalized", action="store_true", help="support weighs by its share of the vertex's summed support")
    p.add_argument("--out", required=True, help="folder for the tables and final.fasta")
    a = p.parse_args(args)
    from braidmill.plans.reconstruct import reconstruct
    from braidmill.sources import files, sinks

    spark = _session()
    if a.fas:
        pairs = files.read_interleaved_pairs(spark, a.fas)
    elif a.fas1 and a.fas2:
        pairs = files.read_paired_files(spark, a.fas1, a.fas2)
    else:
        p.error("give --fas, or --fas1 and --fas2")
    counts = files.read_kmer_counts(spark, a.counts).withColumn("k", F.length("kmer")) if a.counts else None
    options = {"beam": a.M, "insert": a.IS, "edge_threshold": a.graph_threshold, "pair_threshold": a.pair_threshold, "store": a.store, "counts": counts}
    edits = {"tip_coverage": a.tip_coverage, "prune_all": a.prune_all, "least_support": a.least_support, "normalized": a.normalized}
    out = reconstruct(pairs, a.k, a.GL, a.penalty, a.strict, **options, **edits)
    for name, table in out.items():
        table.write.parquet(f"{a.out}/{name}")
    sinks.write_fasta(out["final"], f"{a.out}/final.fasta", "path_id")


if __name__ == "__main__":
    main()
