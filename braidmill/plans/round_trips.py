"""Queries that write a table in a file format of the workflow and read it back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmill.operators import kmers, likelihood
from braidmill.session import new_path
from braidmill.sources import files, sinks

from . import fixtures as X

K = 21
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named_reads(spark, sf_dir) -> DataFrame:
    return X.reads(spark, sf_dir).select(F.concat_ws("/", "rid", "mate").alias("id"), "seq", "mate")


def _text(rows: DataFrame, *lines) -> str:
    """The path of a text file with a record of several lines for each row."""
    path = new_path(rows.sparkSession)
    rows.select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    return path


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@query
def file_fasta(spark, sf_dir):
    """Sequences over two lines, the second in small letters."""
    split = F.concat(F.substring("seq", 1, 25), F.lit("\n"), F.lower(F.substring("seq", 26, 60)))
    path = new_path(spark)
    sinks.write_fasta(_named_reads(spark, sf_dir).withColumn("seq", split), path)
    return files.read_fasta(spark, path)


@query
def file_list(spark, sf_dir):
    """A file that names two others, one of FASTA and one of FASTQ records."""
    reads = _named_reads(spark, sf_dir)
    one = new_path(spark)
    sinks.write_fasta(reads.where("mate = 1"), one)
    two = _text(reads.where("mate = 2"), F.concat(F.lit("@"), "id"), "seq", F.lit("+"), F.regexp_replace("seq", ".", "I"))
    return files.read_sequences(spark, _text(spark.createDataFrame([(one,), (two,)], "name string").coalesce(1), "name"))


@query
def file_fastq(spark, sf_dir):
    path = _text(_named_reads(spark, sf_dir), F.concat(F.lit("@"), "id"), "seq", F.lit("+"), F.translate("seq", "ACGTN", "@+IF#"))
    return files.read_fastq(spark, path)


def _pairs(spark, sf_dir) -> DataFrame:
    return X.read_pairs(spark, sf_dir)


@query
def file_interleaved_pairs(spark, sf_dir):
    path = _text(_pairs(spark, sf_dir), F.lit(">a"), "r1", F.lit(">b"), "r2")
    return files.read_interleaved_pairs(spark, path).groupBy("r1", "r2").agg(F.count("*").alias("n"))


@query
def file_paired_reads(spark, sf_dir):
    """Two folders of files that follow each other in the order of the pairs."""
    pairs = _pairs(spark, sf_dir).orderBy("pair_id")
    one = _text(pairs, F.concat(F.lit("@"), "pair_id"), "r1", F.lit("+"), F.lit("I"))
    two = _text(pairs, F.concat(F.lit(">"), "pair_id"), "r2")
    return files.read_paired_files(spark, one, two)


@query
def file_kmer_text(spark, sf_dir):
    """Above a threshold, with missing complements."""
    path = new_path(spark)
    sinks.write_kmer_text(kmers.count_kmers(X.reads(spark, sf_dir).where("mate = 1"), K), path)
    return files.read_kmer_counts(spark, path, 2, True)


@query
def file_kmer_dots(spark, sf_dir):
    path = new_path(spark)
    sinks.write_kmer_text(kmers.count_kmers(X.reads(spark, sf_dir), K), path, dot=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def file_kmer_folders(spark, sf_dir):
    path = new_path(spark)
    sinks.write_kmer_counts(kmers.count_kmers_multi(X.reads(spark, sf_dir), [31, K]), path)
    return spark.read.parquet(path).select(F.col("k").cast("int").alias("k"), "kmer", "cnt")


@query
def file_histogram(spark, sf_dir):
    path = new_path(spark)
    sinks.write_histogram(kmers.count_kmers_multi(X.reads(spark, sf_dir), [31, K]), path)
    return spark.read.schema("k int, abundance long, n long").csv(path, sep=" ")


@query
def file_kmers_by_count(spark, sf_dir):
    """Places of the k-mers from rare to frequent."""
    path = new_path(spark)
    sinks.write_kmer_text(kmers.by_count(kmers.count_kmers(X.reads(spark, sf_dir), K)), path)
    return files.read_start_order(spark, path).select(F.col("kmer").alias("line"), "ord")


@query
def file_edges(spark, sf_dir):
    path = new_path(spark)
    sinks.write_edges(X.item_graph(spark, sf_dir)["edges"].select(F.col("src").cast("string").alias("u"), F.col("dst").cast("string").alias("v")), path)
    return files.read_edges(spark, path)


@query
def file_pair_support(spark, sf_dir):
    """Of known k-mers only: those with a place before 200."""
    path = new_path(spark)
    sinks.write_pair_support(X.pair_table(spark, sf_dir), path)
    return files.read_pair_support(spark, path, X.placed_kmers(spark, sf_dir).where("depth < 200"))


@query
def file_depths(spark, sf_dir):
    path = new_path(spark)
    places = X.placed_kmers(spark, sf_dir)
    sinks.write_depths(places.select("kmer", "depth", F.col("vid").cast("string").alias("root")), path)
    return files.read_depths(spark, path, places.where("vid < 50"))


@query
def file_condensed_graph(spark, sf_dir):
    """Vertices and edges of one file, told apart again."""
    path = new_path(spark)
    sinks.write_condensed_graph(X.item_places(spark, sf_dir), X.item_graph(spark, sf_dir)["edges"], path)
    vertices, edges = files.read_condensed_graph(spark, path)
    return vertices.select("vid", "seq", F.col("len").cast("long").alias("n")).unionByName(edges.select(F.col("src").alias("vid"), F.lit("").alias("seq"), F.col("dst").alias("n")))


@query
def file_support_lists(spark, sf_dir):
    """Written by vertex, read oriented, with the span of each pair."""
    path, places = new_path(spark), X.item_places(spark, sf_dir)
    sinks.write_support_lists(X.item_graph(spark, sf_dir)["support"], places, path)
    return likelihood.oriented(files.read_support_lists(spark, path, True), places.select("vid", F.length("seq").alias("len")))


@query
def file_paths(spark, sf_dir):
    """Path and header lines of every order's way through its items."""
    paths = X.item_paths(spark, sf_dir).select("path_id", "nodes", F.transform("nodes", lambda v: (v % 8).cast("int")).alias("depths"), (F.size("nodes") / 2).alias("score"), F.lit("A").alias("seq"), F.lit(1).alias("len"))
    path = new_path(spark)
    sinks.path_lines(paths).select(F.substring_index("value", "\n", 2).alias("value")).write.text(path)
    return files.read_paths(spark, path).select("path_id", "header", _joined("nodes"), _joined("depths"))


@query
def file_sam(spark, sf_dir):
    """Alignments of all line items behind a header line."""
    rows, fixed = X.sam(spark, sf_dir), [F.lit(x) for x in ("0", "*", "*", "0", "0", "A", "I")]
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), *fixed, F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    path = new_path(spark)
    rows.select(line.alias("value")).unionByName(spark.createDataFrame([("@HD\tVN:1.0",)], "value string")).write.text(path)
    return files.read_sam(spark, path)


@query
def file_trace(spark, sf_dir):
    path = new_path(spark)
    sinks.write_trace(X.trace(spark, sf_dir).withColumn("step", -F.col("size")), path)
    return files.read_trace(spark, path)


@query
def file_candidate_sets(spark, sf_dir):
    """A line of order numbers for every customer, in their order."""
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    return files.read_candidate_sets(spark, _text(rows.orderBy("o_custkey"), F.array_join(F.transform("o", lambda x: x.cast("string")), ",")))


@query
def file_start_order(spark, sf_dir):
    rows = kmers.count_kmers(X.reads(spark, sf_dir), K).orderBy(F.desc("cnt"), "kmer")
    return files.read_start_order(spark, _text(rows, "kmer"))


@query
def file_k_values(spark, sf_dir):
    """The sizes of all parts as lengths, from the largest down."""
    sizes = _table(spark, sf_dir, "part").select("p_size").distinct().orderBy(F.desc("p_size"))
    ks = files.read_k_values(spark, _text(sizes, F.col("p_size").cast("string")))
    return spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "ord int, k int")
