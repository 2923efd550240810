"""Writers: FASTA and the text forms as lines, tables as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidmill.operators.graph import fastg_lines
from braidmill.operators.kmers import histogram
from braidmill.operators.pairs import support_lists


def fasta_lines(rows: DataFrame, name: str | Column = "id", seq: str = "seq") -> DataFrame:
    name = F.col(name) if isinstance(name, str) else name
    return rows.select(F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(rows: DataFrame, path: str, name: str | Column = "id") -> None:
    fasta_lines(rows, name).write.text(path)


def write_kmer_counts(kmers: DataFrame, path: str) -> None:
    """One folder for every k."""
    kmers.write.partitionBy("k").parquet(path)


def write_kmer_text(kmers: DataFrame, path: str, dot: bool = False) -> None:
    """Lines ``kmer count``; with ``dot`` the lower-cased k-mers, each with a semicolon."""
    line = F.concat(F.lower("kmer"), F.lit(";")) if dot else F.concat_ws(" ", "kmer", F.col("cnt").cast("string"))
    kmers.select(line.alias("value")).write.text(path)


def write_histogram(kmers: DataFrame, path: str) -> None:
    histogram(kmers).orderBy("k", "abundance").write.csv(path, sep=" ")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("u", "v").write.csv(path, sep=" ")


def write_pair_support(pairs: DataFrame, path: str) -> None:
    pairs.select("k1", "k2", "cnt").write.csv(path, sep=" ")


def write_depths(depths: DataFrame, path: str) -> None:
    depths.select("kmer", "depth", "root").write.csv(path, sep=" ")


def condensed_graph_lines(unitigs: DataFrame, cond: DataFrame) -> DataFrame:
    nodes = unitigs.select(F.concat_ws(" ", F.col("vid").cast("string"), "seq").alias("value"))
    return nodes.unionByName(cond.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")))


def write_condensed_graph(unitigs: DataFrame, cond: DataFrame, path: str) -> None:
    condensed_graph_lines(unitigs, cond).write.text(path)


def write_support_lists(compat: DataFrame, vertices: DataFrame, path: str) -> None:
    support_lists(compat, vertices).select(F.col("line").alias("value")).write.text(path)


def path_lines(paths: DataFrame) -> DataFrame:
    """(value): a path line ``1:node depth 2:node depth ...``, the header and the sequence."""
    steps = F.transform(F.arrays_zip("nodes", "depths"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x["nodes"].cast("string"), F.lit(" "), x["depths"].cast("string")))
    head = F.concat(F.lit(">"), F.col("score").cast("string"), F.lit(">"), F.col("path_id").cast("string"), F.lit("__"), F.col("len").cast("string"))
    return paths.select(F.concat_ws("\n", F.array_join(steps, " "), head, "seq").alias("value"))


def write_paths(paths: DataFrame, path: str) -> None:
    path_lines(paths).write.text(path)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.orderBy("step").select("size", "loglik", "removed", "missed").write.csv(path, sep=" ")


def write_fastg(unitigs: DataFrame, cond: DataFrame, k: int, path: str) -> None:
    fastg_lines(unitigs, cond, k).select(F.concat_ws("\n", "header", "seq").alias("value")).write.text(path)
