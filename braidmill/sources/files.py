"""Readers for sequence files and the plain-text tables of the workflow.

All go through Spark's text reader, so any file system it knows will do and
compressed files are read as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidmill.operators.kmers import above, with_complements

#: Files that a list file may name.
MOST_FILES = 2000


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """reads(id, seq): one row a record; sequences may span lines and are upper-cased."""
    body = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>|\r", "").alias("v"))
    head = F.element_at(F.split("v", "\n", 2), 1)
    rest = F.coalesce(F.get(F.split("v", "\n", 2), 1), F.lit(""))
    return body.where(F.trim("v") != "").select(F.trim(head).alias("id"), F.upper(F.regexp_replace(rest, r"\s", "")).alias("seq"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """reads(id, seq, qual) of records of four lines, told apart by line number; each file begins with a record."""
    return _fastq(spark, paths).select("id", "seq", "qual")


def _fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records with ``at``, their place."""
    lines = _ordered(spark.read.text(paths).select(F.rtrim("value").alias("line")))
    line = lambda k: F.max(F.when(F.col("at") % 4 == k, F.col("line")))
    rows = lines.groupBy(F.floor(F.col("at") / 4).alias("at")).agg(line(0).alias("id"), F.upper(line(1)).alias("seq"), line(3).alias("qual"))
    return rows.where(F.col("id").startswith("@")).select(F.substring("id", F.lit(2), F.length("id")).alias("id"), "seq", "qual", "at")


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The file names of a list; a file of more lines is no list and is not read on."""
    names = [r[0].strip() for r in spark.read.text(path).limit(MOST_FILES + 1).collect()]
    if len(names) > MOST_FILES:
        raise ValueError(f"{path} is neither FASTA nor FASTQ, and a list names {MOST_FILES} files at most")
    return [n for n in names if n]


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """reads(id, seq) of FASTA or FASTQ files, or of the files that a list file names, ``MOST_FILES`` at most."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for p in paths:
        first = spark.read.text(p).first()
        sign = first[0][:1] if first else ">"
        part = read_fasta(spark, p) if sign == ">" else read_fastq(spark, p).select("id", "seq") if sign == "@" else read_sequences(spark, _listed(spark, p))
        out = part if out is None else out.unionByName(part)
    return out


def read_k_values(spark: SparkSession, path: str) -> list[int]:
    """The listed lengths, which must go down from line to line."""
    ks = [int(r[0]) for r in spark.read.text(path).collect() if r[0].strip()]
    if ks != sorted(set(ks), reverse=True):
        raise ValueError(f"the lengths must decrease: {ks}")
    return ks


def sample_of_files(paths: list[str], share: int = 20) -> list[str]:
    """The first twentieth of the files (one at least), for estimates."""
    return paths[: max(1, len(paths) // share)]


def _ordered(rows: DataFrame) -> DataFrame:
    """rows of a text source plus ``at``, their place in order of file name and place in the file.

    Spark deals blocks of files to tasks in an order of its own, but reads each
    block from begin to end.  So a row's place is the number of rows in the
    blocks before (one small row a block) plus its place in its block.
    """
    block = ["bm_file", "bm_from"]
    marked = rows.select("*", F.col("_metadata.file_path").alias("bm_file"), F.col("_metadata.file_block_start").alias("bm_from"), F.monotonically_increasing_id().alias("bm_id"))
    blocks = marked.groupBy(*block).agg(F.min("bm_id").alias("bm_first"), F.count("*").alias("bm_n")).collect()
    blocks.sort(key=lambda r: (r["bm_file"], r["bm_from"]))
    shift, before = [], 0
    for r in blocks:
        shift.append((r["bm_file"], r["bm_from"], before - r["bm_first"]))
        before += r["bm_n"]
    table = rows.sparkSession.createDataFrame(shift, "bm_file string, bm_from long, bm_shift long")
    placed = marked.join(F.broadcast(table), block)  # a row a block of a file
    return placed.select(*rows.columns, (F.col("bm_id") + F.col("bm_shift")).alias("at"))


def read_interleaved_pairs(spark: SparkSession, path: str) -> DataFrame:
    """read_pairs(pair_id, r1, r2) from a FASTA file in which mates follow each other."""
    rows = _ordered(read_fasta(spark, path).select("seq"))
    by = rows.groupBy(F.floor(F.col("at") / 2).alias("pair_id"))
    return by.agg(F.max(F.when(F.col("at") % 2 == 0, F.col("seq"))).alias("r1"), F.max(F.when(F.col("at") % 2 == 1, F.col("seq"))).alias("r2")).where("r2 is not null")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(seq, at) of the records of a FASTA or FASTQ file."""
    first = spark.read.text(path).first()
    if first and first[0].startswith("@"):
        return _fastq(spark, path).select("seq", "at")
    return _ordered(read_fasta(spark, path).select("seq"))


def read_paired_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """read_pairs(pair_id, r1, r2) from two files whose records correspond by order."""
    one, two = _placed(spark, first), _placed(spark, second)
    return one.select(F.col("at").alias("pair_id"), F.col("seq").alias("r1")).join(two.select(F.col("at").alias("pair_id"), F.col("seq").alias("r2")), "pair_id")


def _fields(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep)


def read_kmer_counts(spark: SparkSession, path: str, threshold: int | None = None, both_strands: bool = False) -> DataFrame:
    """kmers(kmer, cnt) from lines ``kmer count``; above a threshold, and with missing complements, if asked."""
    out = _fields(spark, path, "kmer string, cnt long")
    out = out if threshold is None else above(out, threshold)
    return with_complements(out) if both_strands else out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, "u string, v string").distinct()


def read_pair_support(spark: SparkSession, path: str, kmers: DataFrame | None = None) -> DataFrame:
    """pairs(k1, k2, cnt) from lines ``kmer kmer count``, of known k-mers only if these are given."""
    out = _fields(spark, path, "k1 string, k2 string, cnt long")
    if kmers is not None:
        known = kmers.select("kmer").distinct()
        out = out.join(known.withColumnRenamed("kmer", "k1"), "k1", "left_semi").join(known.withColumnRenamed("kmer", "k2"), "k2", "left_semi")
    return out


def read_depths(spark: SparkSession, path: str, kmers: DataFrame | None = None) -> DataFrame:
    """depth(kmer, depth, root) from lines ``kmer depth root``."""
    out = _fields(spark, path, "kmer string, depth int, root string")
    return out if kmers is None else out.join(kmers.select("kmer"), "kmer", "left_semi")


def read_condensed_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(unitigs(vid, seq, len), cond_edges(src, dst)) from one file of ``id sequence`` and ``id id`` lines."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    is_seq = F.get("p", 1).rlike("[AGCT]")
    unitigs = p.where(is_seq).select(F.get("p", 0).cast("long").alias("vid"), F.get("p", 1).alias("seq")).withColumn("len", F.length("seq"))
    return unitigs, p.where(~is_seq).select(F.get("p", 0).cast("long").alias("src"), F.get("p", 1).cast("long").alias("dst"))


def read_support_lists(spark: SparkSession, path: str, oriented: bool = False) -> DataFrame:
    """compat(v1, d1, v2, d2, cnt) from lines ``v1:d1 v2:d2:count ...``; only d2 >= d1 if oriented."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    head = F.split(F.get("p", 0), ":")
    rows = p.select(head.alias("h"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("m")).select("h", F.split("m", ":").alias("m"))
    out = rows.select(F.get("h", 0).cast("long").alias("v1"), F.get("h", 1).cast("int").alias("d1"), F.get("m", 0).cast("long").alias("v2"), F.get("m", 1).cast("int").alias("d2"), F.get("m", 2).cast("long").alias("cnt"))
    return out.where("d2 >= d1") if oriented else out


def read_paths(spark: SparkSession, path: str, whole_key: bool = True) -> DataFrame:
    """paths(path_id string, header, nodes, depths) from records of a path line and a header line.

    ``path_id`` is the header up to its first underscore: ``score>id``, or the
    id alone if ``whole_key`` is off.
    """
    lines = _ordered(spark.read.text(path).where(F.trim("value") != ""))
    line = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("value")))
    pairs = lines.groupBy(F.floor(F.col("at") / 2).alias("n")).agg(line(0).alias("p"), line(1).alias("h"))
    parts = F.filter(F.split(F.trim("p"), r"\s+"), lambda x: x != "")
    key = F.element_at(F.split(F.substring("h", F.lit(2), F.length("h")), "_"), 1)
    key = key if whole_key else F.element_at(F.split(key, ">"), -1)
    nodes = F.transform(F.filter(parts, lambda x: F.contains(x, F.lit(":"))), lambda x: F.element_at(F.split(x, ":"), 2).cast("long"))
    depths = F.transform(F.filter(parts, lambda x: ~F.contains(x, F.lit(":"))), lambda x: x.cast("int"))
    return pairs.select(key.alias("path_id"), F.col("h").alias("header"), nodes.alias("nodes"), depths.alias("depths"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """sam(qname, flag, rname, pos, nm); header lines are skipped, nm is the NM tag of the twelfth column."""
    p = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("p"))
    return p.select(F.get("p", 0).alias("qname"), F.get("p", 1).cast("int").alias("flag"), F.get("p", 2).alias("rname"), F.get("p", 3).cast("int").alias("pos"), F.element_at(F.split(F.get("p", 11), ":"), -1).cast("int").alias("nm"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, "size int, loglik double, removed string, missed double")


def read_candidate_sets(spark: SparkSession, path: str) -> DataFrame:
    """sets(set_id, path_id): a line of ids with commas is a set; set_id is the line's number from 0, blank lines aside."""
    rows = _ordered(spark.read.text(path).where(F.trim("value") != ""))
    return rows.select(F.col("at").alias("set_id"), F.explode(F.split("value", ",")).alias("path_id")).select("set_id", F.trim("path_id").alias("path_id"))


def read_start_order(spark: SparkSession, path: str) -> DataFrame:
    """order(kmer, ord): first k-mers in the order in which a search should start."""
    rows = _ordered(spark.read.text(path).select(F.trim("value").alias("kmer")))
    return rows.select("kmer", F.col("at").alias("ord"))


def read_packed_counts(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """kmers(k, kmer, cnt) from binary files: bits and k as 32-bit numbers, then (k-mer, 32-bit count) records."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["content"]:
                b = blob.as_py()
                bits, k = np.frombuffer(b[:8], "<i4").tolist()
                width = bits // 8
                rec = np.frombuffer(b[8:], np.uint8).reshape(-1, width + 4)
                cnt = rec[:, width:].copy().view("<u4").ravel()
                digit = np.unpackbits(rec[:, :width], axis=1, bitorder="little").reshape(len(rec), -1, 2) @ np.array([1, 2])
                letters = np.frombuffer(b"ACTG", np.uint8)[digit[:, :k][:, ::-1]]
                keep = cnt >= least
                kmers = [bytes(x).decode() for x in letters[keep]]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(kmers), pa.int32()), pa.array(kmers, pa.string()), pa.array(cnt[keep].astype(np.int64))], names=["k", "kmer", "cnt"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "k int, kmer string, cnt long")
