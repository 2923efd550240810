"""Comparing reconstructed sequences with known ones, and cleaning up inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmill.functions import sequences as S

#: Bases of known sequences that are broadcast, and of a prediction that larger ones are looked up by.
BROADCAST_BASES, SEED = 4_000_000, 24
#: Reads, and ranges of reads, that are numbered in one task.
RANGE = 4096


def unique_truths(truths: DataFrame) -> DataFrame:
    """(seq, ids): one row for each distinct known sequence with the ids that share it."""
    return truths.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("hap_id")), ",").alias("ids"))


def containment(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """(ids, found_id, strand): predictions that lie inside a known sequence or its complement.

    Known sequences of up to ``BROADCAST_BASES`` together are taken to all
    predictions; more meet them by the prediction's first ``SEED`` bases.
    """
    known = unique_truths(truths).select("ids", F.col("seq").alias("truth"), S.revcomp(F.col("seq")).alias("truth_rc"))
    found = predictions.select(F.col("path_id").alias("found_id"), "seq")
    inside = F.contains(F.col("truth"), F.col("seq")) | F.contains(F.col("truth_rc"), F.col("seq"))
    bases = known.agg(F.sum(F.length("truth").cast("long"))).first()[0] or 0
    if bases <= BROADCAST_BASES:
        both = found.join(F.broadcast(known), inside)
    else:
        size = F.least(F.length("seq"), F.lit(SEED))
        sizes = [r[0] for r in found.select(size).distinct().collect()]  # SEED + 1 values at most
        starts = lambda t, n: F.transform(F.sequence(F.lit(0), F.length(t) - n), lambda i: F.substring(t, i + 1, F.lit(n)))
        cuts = [F.when(F.length("truth") >= n, F.concat(starts(F.col("truth"), n), starts(F.col("truth_rc"), n))).otherwise(F.array().cast("array<string>")) for n in sizes]
        seeds = known.select("ids", F.explode(F.array_distinct(F.flatten(F.array(*cuts)))).alias("seed")) if cuts else known.select("ids", F.lit("").alias("seed"))
        near = found.withColumn("seed", F.substring("seq", F.lit(1), size)).join(seeds, "seed").drop("seed")
        both = near.join(known, "ids").where(inside)
    return both.select("ids", "found_id", F.when(F.contains(F.col("truth"), F.col("seq")), "+").otherwise("-").alias("strand"))


def unmatched_truths(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """(ids) of the distinct known sequences in which no prediction lies."""
    return unique_truths(truths).select("ids").join(containment(truths, predictions).select("ids").distinct(), "ids", "left_anti")


def best_per_reference(sam: DataFrame) -> DataFrame:
    """(rname, qname, nm): the nearest sequence of each reference; ties go to the smallest name."""
    best = sam.groupBy("rname").agg(F.min(F.struct("nm", "qname")).alias("b"))
    return best.select("rname", "b.qname", "b.nm")


def best_per_sequence(sam: DataFrame) -> DataFrame:
    """(qname, rname, nm): the nearest reference of each sequence."""
    best = sam.groupBy("qname").agg(F.min(F.struct("nm", "rname")).alias("b"))
    return best.select("qname", "b.rname", "b.nm")


def sequences_by_reference(sam: DataFrame) -> DataFrame:
    """(rname, rank, qname, nm): the sequences nearest to each reference, in order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("rname").orderBy("nm", "qname")
    return best_per_sequence(sam).withColumn("rank", F.row_number().over(w)).select("rname", "rank", "qname", "nm")


def distance_histogram(sam: DataFrame) -> DataFrame:
    """(nm, n): how many sequences have which distance to their nearest reference."""
    return best_per_sequence(sam).groupBy("nm").agg(F.count("*").alias("n"))


def length_histogram(sam: DataFrame) -> DataFrame:
    """(len, n) of the sequences, from the length at the end of their names."""
    length = F.element_at(F.split("qname", "__"), -1).cast("int")
    return sam.select("qname").distinct().groupBy(length.alias("len")).agg(F.count("*").alias("n"))


def mean_distance(sam: DataFrame) -> DataFrame:
    """(rname, n, mean_nm) over the sequences whose nearest reference it is."""
    return best_per_sequence(sam).groupBy("rname").agg(F.count("*").alias("n"), F.avg("nm").alias("mean_nm"))


def merge_equal_slices(aligned: DataFrame, start: int, end: int) -> DataFrame:
    """(slice, ids): rows with the same columns of an alignment become one."""
    return aligned.groupBy(S.column_slice(F.col("seq"), start, end).alias("slice")).agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"))


def choose_strands(sam: DataFrame) -> DataFrame:
    """(qname, pos, turned): flag 16 turns a read; a row with flag 0 for the same read and place wins."""
    return sam.where(F.col("flag").isin(0, 16)).groupBy("qname", "pos").agg(F.min(F.col("flag") == 16).alias("turned"))


def strand_pairs(reads: DataFrame, sam: DataFrame) -> DataFrame:
    """(read_id, plus_seq, r1_mate, r1, r2_mate, r2): both strands of every read that aligned with flag 0 or 16.

    ``sam`` names rows ``read/mate``.  ``r1`` is the mate with flag 0 and ``r2``
    the one with flag 16; where one is missing, the complement of the other
    stands for it under the other mate's number.  ``plus_seq`` faces forward:
    the mate with flag 0, else the turned one with flag 16.  Of several mates
    with one flag the higher counts.
    """
    name = F.split("qname", "/")
    ends = sam.where(F.col("flag").isin(0, 16)).select(F.get(name, 0).alias("read_id"), F.get(name, 1).cast("int").alias("mate"), "flag")
    ends = ends.groupBy("read_id").agg(F.max(F.when(F.col("flag") == 0, F.col("mate"))).alias("plus"), F.max(F.when(F.col("flag") == 16, F.col("mate"))).alias("minus"))
    rows = reads.select(F.col("read_id").cast("string").alias("read_id"), "mate", "seq").join(ends, "read_id")
    both = rows.groupBy("read_id", "plus", "minus").agg(F.max(F.when(F.col("mate") == F.col("plus"), F.col("seq"))).alias("p"), F.max(F.when(F.col("mate") == F.col("minus"), F.col("seq"))).alias("m"))
    forward = F.coalesce("p", S.revcomp(F.col("m")))
    return both.where("p is not null or m is not null").select(
        "read_id",
        forward.alias("plus_seq"),
        F.coalesce("plus", 3 - F.col("minus")).alias("r1_mate"),
        forward.alias("r1"),
        F.coalesce("minus", 3 - F.col("plus")).alias("r2_mate"),
        F.coalesce("m", S.revcomp(F.col("p"))).alias("r2"),
    )


def fix_strands(reads: DataFrame, strands: DataFrame) -> DataFrame:
    """(read_id, seq) facing the way the alignment says."""
    rows = reads.join(strands, "read_id")
    return rows.select("read_id", F.when(F.col("turned"), S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def pair_up(reads: DataFrame) -> DataFrame:
    """read_pairs(pair_id, r1, r2) of reads(read_id, mate, seq) that have both mates left."""
    by = reads.groupBy(F.col("read_id").alias("pair_id")).agg(F.max(F.when(F.col("mate") == 1, F.col("seq"))).alias("r1"), F.max(F.when(F.col("mate") == 2, F.col("seq"))).alias("r2"))
    return by.where("r1 is not null and r2 is not null")


def paths_of_centroids(paths: DataFrame, centroids: DataFrame) -> DataFrame:
    """paths whose header is one of the centroids' (up to the first blank), in the centroids' order."""
    key = F.element_at(F.split("header", r"\s+"), 1)
    return paths.withColumn("key", key).join(centroids.select(key.alias("key"), "ord"), "key").drop("key")


def longer_than(rows: DataFrame, least: int) -> DataFrame:
    return rows.where(F.length("seq") > least)


def numbered_reads(reads: DataFrame) -> DataFrame:
    """(header, seq): reads named by number and length, in order of read_id and mate."""
    from pyspark.sql.window import Window

    # numbers within ranges of ids, then the ranges' totals within ranges of ranges: no task sees all reads or all ranges
    rows = reads.select("read_id", "mate", "seq", F.floor(F.col("read_id") / RANGE).alias("part"))
    totals = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("part") / RANGE))
    lower = totals.select("part", "upper", (F.sum("n").over(Window.partitionBy("upper").orderBy("part")) - F.col("n")).alias("lower_before"))
    uppers = totals.groupBy("upper").agg(F.sum("n").alias("n"))
    higher = uppers.select("upper", (F.sum("n").over(Window.orderBy("upper")) - F.col("n")).alias("upper_before"))  # a row for RANGE * RANGE ids
    before = lower.join(higher, "upper").select("part", (F.col("lower_before") + F.col("upper_before")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("read_id", "mate"))
    out = rows.withColumn("i", inner).join(before, "part")
    return out.select(F.concat_ws("_", (F.col("before") + F.col("i")).cast("string"), F.length("seq").cast("string")).alias("header"), "seq")


def reversed_reads(reads: DataFrame) -> DataFrame:
    """(id, seq): every read's complement, named with _rev."""
    return reads.select(F.concat(F.col("id").cast("string"), F.lit("_rev")).alias("id"), S.revcomp(F.upper("seq")).alias("seq"))
