"""Support of k-mer pairs by read pairs, and its sums between vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidmill.functions import sequences as S

from .kmers import times

#: Least distance between the two k-mers of a pair inside one mate.
GAP = 5


def counted_pairs(read_pairs: DataFrame) -> DataFrame:
    """(r1, r2, times): the distinct read pairs as they were read, which all steps take instead of the pairs."""
    return read_pairs.groupBy("r1", "r2").agg(times(read_pairs).alias("times"))


def _distinct_pairs(read_pairs: DataFrame) -> DataFrame:
    """Equal read pairs meet before the quadratic step; both mates face the same way."""
    return read_pairs.groupBy(F.upper("r1").alias("r1"), S.revcomp(F.upper("r2")).alias("r2")).agg(times(read_pairs).alias("times"))


def _fine(kmer: str) -> F.Column:
    return S.has_no_n(F.col(kmer))


def pairs_within_mates(read_pairs: DataFrame, k: int, gap: int = GAP) -> DataFrame:
    """(k1, k2, cnt): k-mers of one mate at positions i and j >= i + gap."""
    mates = _distinct_pairs(read_pairs).select(F.explode(F.array("r1", "r2")).alias("seq"), "times")
    placed = mates.select(S.kmer_array(F.col("seq"), k).alias("ks"), "times").select("ks", "times", F.posexplode("ks").alias("i", "k1"))
    both = placed.select("k1", F.explode(F.slice("ks", F.col("i") + gap + 1, F.greatest(F.size("ks") - F.col("i") - gap, F.lit(0)))).alias("k2"), "times")
    return both.where(_fine("k1") & _fine("k2")).groupBy("k1", "k2").agg(F.sum("times").alias("cnt"))


def pairs_across_mates(read_pairs: DataFrame, k: int) -> DataFrame:
    """(k1, k2, cnt): every k-mer of the first mate with every one of the turned second."""
    rows = _distinct_pairs(read_pairs).select(F.explode(S.kmer_array(F.col("r1"), k)).alias("k1"), S.kmer_array(F.col("r2"), k).alias("ks"), "times")
    both = rows.where(_fine("k1")).select("k1", F.explode("ks").alias("k2"), "times")
    return both.where(_fine("k2")).groupBy("k1", "k2").agg(F.sum("times").alias("cnt"))


def pair_support(read_pairs: DataFrame, kmers: DataFrame, k: int, threshold: int = 0, store: int = 1, gap: int = GAP) -> DataFrame:
    """(k1, k2, cnt): pairs on both strands, seen more than ``store`` times.

    Both k-mers must be known (above ``threshold``) on either strand.  The
    support is symmetric under complement, so the forward half is summed first
    and then added to its mirror image.
    """
    forward = pairs_within_mates(read_pairs, k, gap).unionByName(pairs_across_mates(read_pairs, k))
    known = kmers.where(F.col("cnt") > threshold).select("kmer")
    known = known.unionByName(known.select(S.revcomp(F.col("kmer")).alias("kmer"))).distinct()
    forward = forward.join(known.withColumnRenamed("kmer", "k1"), "k1", "left_semi").join(known.withColumnRenamed("kmer", "k2"), "k2", "left_semi")
    forward = forward.groupBy("k1", "k2").agg(F.sum("cnt").alias("cnt"))
    both = forward.unionByName(forward.select(S.revcomp(F.col("k2")).alias("k1"), S.revcomp(F.col("k1")).alias("k2"), "cnt"))
    return both.groupBy("k1", "k2").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") > store)


def known_pairs(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs with vertex and depth of both k-mers; pairs with unknown k-mers drop out."""
    one = places.select(F.col("kmer").alias("k1"), F.col("vid").alias("v1"), F.col("depth").alias("d1"))
    two = places.select(F.col("kmer").alias("k2"), F.col("vid").alias("v2"), F.col("depth").alias("d2"))
    return pairs.join(one, "k1").join(two, "k2")


def mean_gap(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(n_pairs, mean_gap): over distinct pairs whose second k-mer is not above the first."""
    gap = F.col("d2") - F.col("d1")
    return known_pairs(pairs, places).where("d2 >= d1").agg(F.count("*").alias("n_pairs"), F.avg(gap).alias("mean_gap"))


def compatible_set(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(v1, v2, cnt): support between vertices, from the shallower k-mer to the deeper one."""
    known = known_pairs(pairs, places)
    down = F.col("d2") > F.col("d1")
    turned = known.select(F.when(down, F.col("v1")).otherwise(F.col("v2")).alias("v1"), F.when(down, F.col("v2")).otherwise(F.col("v1")).alias("v2"), "cnt")
    return turned.groupBy("v1", "v2").agg(F.sum("cnt").alias("cnt"))


def bubble_vertices(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    """(vid): vertices that share their depth with another, and all sources and sinks."""
    from .graph import vertex_sinks, vertex_sources

    shared = vertices.withColumn("n", F.count("*").over(Window.partitionBy("depth"))).where("n > 1").select("vid")
    return shared.unionByName(vertex_sources(vertices, cond)).unionByName(vertex_sinks(vertices, cond)).distinct()


def bubble_set(pairs: DataFrame, places: DataFrame, bubbles: DataFrame, cond: DataFrame) -> DataFrame:
    """(v1, v2, cnt): support between bubble vertices, plus every other edge with count 1."""
    known = known_pairs(pairs, places).select("v1", "v2", "cnt")
    known = known.join(bubbles.withColumnRenamed("vid", "v1"), "v1", "left_semi").join(bubbles.withColumnRenamed("vid", "v2"), "v2", "left_semi")
    summed = known.groupBy("v1", "v2").agg(F.sum("cnt").alias("cnt"))
    rest = cond.select(F.col("src").alias("v1"), F.col("dst").alias("v2")).distinct().join(summed, ["v1", "v2"], "left_anti")
    return summed.unionByName(rest.withColumn("cnt", F.lit(1).cast("long")))


def membership(compat: DataFrame, normalized: bool = False) -> DataFrame:
    """compat plus weight: its count by the number of partners, or by their summed counts."""
    w = Window.partitionBy("v1")
    total = F.sum("cnt").over(w) if normalized else F.count("*").over(w)
    return compat.withColumn("weight", F.col("cnt") / total)


def filter_compatible(compat: DataFrame, threshold: int = 10) -> DataFrame:
    return compat.where(F.col("cnt") > threshold)


def edges_with_support(edges: DataFrame, places: DataFrame, compat: DataFrame) -> DataFrame:
    """K-mer edges neither end of which lies in a vertex without any kept support."""
    alive = compat.select(F.col("v1").alias("vid")).unionByName(compat.select(F.col("v2").alias("vid"))).distinct()
    lost = places.join(alive, "vid", "left_anti").select("kmer")
    return edges.join(lost.withColumnRenamed("kmer", "u"), "u", "left_anti").join(lost.withColumnRenamed("kmer", "v"), "v", "left_anti").select("u", "v")


def support_lists(compat: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v1, line): one text line a vertex, ``v1:d1 v2:d2:count ...``; members by depth of their first k-mer."""
    depth = vertices.select("vid", "depth")
    rows = compat.join(depth.select(F.col("vid").alias("v2"), F.col("depth").alias("d2")), "v2").groupBy("v1").agg(F.array_sort(F.collect_list(F.struct("d2", "v2", "cnt"))).alias("m"))
    part = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["v2"].cast("string"), x["d2"].cast("string"), x["cnt"].cast("string"))), " ")
    return rows.join(depth.select(F.col("vid").alias("v1"), F.col("depth").alias("d1")), "v1").select("v1", F.concat(F.concat_ws(":", F.col("v1").cast("string"), F.col("d1").cast("string")), F.lit(" "), part).alias("line"))
