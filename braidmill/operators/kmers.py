"""Exact k-mer counting and what is derived from counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidmill.functions import sequences as S
from braidmill.session import materialize

MAX_COUNT = 2147483646
HISTOGRAM_TOP = 10000


def times(rows: DataFrame) -> Column:
    """How often rows occur, as an aggregate: their number, or the sum of ``times`` where they have been counted before."""
    return F.sum("times") if "times" in rows.columns else F.count("*")


def _segments(reads: DataFrame) -> DataFrame:
    """N-free stretches with their number; equal stretches meet before they are cut up."""
    counted = [c for c in reads.columns if c == "times"]
    return reads.select(F.explode(S.segments(F.upper("seq"))).alias("seq"), *counted).groupBy("seq").agg(times(reads).alias("times"))


def kmer_words(reads: DataFrame, k: int) -> DataFrame:
    """(kmer): every occurrence in ``reads(seq)``, none with an N."""
    return reads.select(F.explode(S.segments(F.upper("seq"))).alias("seq")).select(F.explode(S.kmer_array(F.col("seq"), k)).alias("kmer"))


def counted_words(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, times): the words of each distinct stretch of ``reads(seq)``; the stretches are counted and written once, for several passes."""
    return materialize(_segments(reads)).select(F.explode(S.kmer_array(F.col("seq"), k)).alias("kmer"), "times")


def count_kmers(reads: DataFrame, k: int) -> DataFrame:
    """kmers(k, kmer, cnt) of ``reads(seq)``, strand by strand; reads that were counted before have ``times``.

    Equal reads are counted first, so deep coverage is cut up once; the counts
    of k-mers are partial sums before the shuffle.
    """
    words = _segments(reads).select(F.explode(S.kmer_array(F.col("seq"), k)).alias("kmer"), "times")
    return words.groupBy("kmer").agg(F.sum("times").alias("cnt")).select(F.lit(k).alias("k"), "kmer", "cnt")


def count_kmers_multi(reads: DataFrame, ks: list[int]) -> DataFrame:
    """kmers of several lengths from one pass.

    Words of the largest k are counted; the k-mers of each smaller k are their
    suffixes, plus the k-mers that begin a stretch before any word ends there.
    """
    ks = sorted(set(ks), reverse=True)
    top = ks[0]
    segments = _segments(reads)
    whole = segments.select(F.explode(S.kmer_array(F.col("seq"), top)).alias("word"), "times").groupBy("word").agg(F.sum("times").alias("cnt"))
    out = whole.select(F.lit(top).alias("k"), F.col("word").alias("kmer"), "cnt")
    for k in ks[1:]:
        ends = whole.select(F.right("word", F.lit(k)).alias("kmer"), F.col("cnt").alias("times"))
        heads = segments.select(F.explode(S.kmer_array(F.substring("seq", 1, top - 1), k)).alias("kmer"), "times")
        both = ends.unionByName(heads).groupBy("kmer").agg(F.sum("times").alias("cnt"))
        out = out.unionByName(both.select(F.lit(k).alias("k"), "kmer", "cnt"))
    return out


def count_canonical(reads: DataFrame, k: int, keep_palindromes: bool = False) -> DataFrame:
    """Counts over both strands, one row for a k-mer and its complement.

    The smaller of both in packed order names the row; k-mers that are their
    own complement are left out unless asked for.
    """
    both = count_kmers(reads, k).select(S.canonical(F.col("kmer")).alias("kmer"), F.when(F.col("kmer") == S.revcomp(F.col("kmer")), 2 * F.col("cnt")).otherwise(F.col("cnt")).alias("cnt"))
    out = both.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    if not keep_palindromes:
        out = out.where(F.col("kmer") != S.revcomp(F.col("kmer")))
    return out.select(F.lit(k).alias("k"), "kmer", "cnt")


def merge_canonical(kmers: DataFrame) -> DataFrame:
    """(kmer, cnt) with the counts of a k-mer and its complement added up, named alphabetically."""
    return kmers.groupBy(S.canonical_text(F.col("kmer")).alias("kmer")).agg(F.sum("cnt").alias("cnt"))


def solid(kmers: DataFrame, least: int, most: int = MAX_COUNT) -> DataFrame:
    """K-mers seen at least ``least`` and at most ``most`` times."""
    return kmers.where(F.col("cnt").between(least, most))


def above(kmers: DataFrame, threshold: int) -> DataFrame:
    """K-mers seen more than ``threshold`` times."""
    return kmers.where(F.col("cnt") > threshold)


def with_complements(kmers: DataFrame) -> DataFrame:
    """(kmer, cnt) plus the complements that are missing, with the same count."""
    own = kmers.select("kmer", "cnt", F.lit(1).alias("own"))
    back = kmers.select(S.revcomp(F.col("kmer")).alias("kmer"), "cnt", F.lit(0).alias("own"))
    return own.unionByName(back).groupBy("kmer").agg(F.max_by("cnt", "own").alias("cnt"))


def histogram(kmers: DataFrame, top: int = HISTOGRAM_TOP) -> DataFrame:
    """(k, abundance, n): how many k-mers were seen so often; the last bin takes all above."""
    return kmers.groupBy("k", F.least("cnt", F.lit(top)).alias("abundance")).agg(F.count("*").alias("n"))


def partition_volumes(kmers: DataFrame, letters: int) -> DataFrame:
    """(bin, volume): k-mer occurrences by their last letters."""
    return kmers.groupBy(F.right("kmer", F.lit(letters)).alias("bin")).agg(F.sum("cnt").alias("volume"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kmer, cnt_a, cnt_b) of k-mers of ``a`` whose count in ``b`` (0 if missing) differs."""
    b = b.select("kmer", F.col("cnt").alias("cnt_b"))
    out = a.select("kmer", F.col("cnt").alias("cnt_a")).join(b, "kmer", "left").withColumn("cnt_b", F.coalesce("cnt_b", F.lit(0).cast("long")))
    return out.where("cnt_a <> cnt_b")


def _cell(value: Column, cells: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long") % cells


def linear_count(values: DataFrame, column: str, cells: int) -> DataFrame:
    """(cells, used, estimate, reliable): distinct values from the used cells of one hash.

    estimate = -cells * ln((cells - used) / cells); reliable below a load of 0.99.
    """
    used = values.select(_cell(F.col(column), cells).alias("cell")).distinct().agg(F.count("*").alias("used"))
    estimate = -F.lit(float(cells)) * F.ln((F.lit(cells) - F.col("used")) / F.lit(cells))
    return used.select(F.lit(cells).cast("long").alias("cells"), "used", estimate.alias("estimate"), (F.col("used") / cells < 0.99).alias("reliable"))


def approximate_distinct(values: DataFrame, column: str, error: float = 0.01) -> DataFrame:
    return values.agg(F.approx_count_distinct(column, error).alias("distinct_about"))


def value_frequencies(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(column).agg(F.count("*").alias("n"))


def saturating_counts(values: DataFrame, column: str, bits: int = 4) -> DataFrame:
    """(value, level): exact counts capped like a counter of so many bits."""
    return values.groupBy(column).agg(F.least(F.count("*"), F.lit((1 << bits) - 1).cast("long")).alias("level"))


def _bloom_cells(column: str, cells: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(cells)) for i in range(hashes)])


def bloom_cells(values: DataFrame, column: str, cells: int, hashes: int = 4) -> DataFrame:
    """(cell): the bits that a Bloom filter of the values has set, one row each."""
    return values.select(F.explode(_bloom_cells(column, cells, hashes)).alias("cell")).distinct()


def bloom_filtered(values: DataFrame, column: str, bloom: DataFrame, cells: int, hashes: int = 4) -> DataFrame:
    """Distinct values all of whose bits are set: all that were put in, and a few others."""
    asked = values.select(column).distinct().select(column, F.explode(F.array_distinct(_bloom_cells(column, cells, hashes))).alias("cell"))
    missing = asked.join(bloom, "cell", "left_anti").select(column).distinct()
    return asked.select(column).distinct().join(missing, column, "left_anti")


def by_count(kmers: DataFrame) -> DataFrame:
    """K-mers from rare to frequent; of equal counts in alphabetical order."""
    return kmers.orderBy("cnt", "kmer")


def sampled_distinct(values: DataFrame, column: str, rate: float, seed: int = 1) -> DataFrame:
    """(sampled, seen, estimate): distinct values extrapolated from a hash sample of values."""
    share = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 20)) < math.ceil(rate * (1 << 20))
    return values.where(share).agg(F.count("*").alias("sampled"), F.countDistinct(column).alias("seen")).withColumn("estimate", F.col("seen") / rate)


def read_statistics(reads: DataFrame, k: int) -> DataFrame:
    """(n_reads, longest, volume): reads, their largest length and the k-mers in them."""
    n = F.greatest(F.length("seq") - k + 1, F.lit(0))
    return reads.agg(F.count("*").alias("n_reads"), F.max(F.length("seq")).cast("long").alias("longest"), F.sum(n).cast("long").alias("volume"))


def merge_partial_counts(parts: list[DataFrame], least: int = 1) -> DataFrame:
    """(kmer, cnt): counts of successive passes added up; rare ones go at the end."""
    out = parts[0].select("kmer", "cnt")
    for p in parts[1:]:
        out = out.unionByName(p.select("kmer", "cnt"))
    return out.groupBy("kmer").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= least)


def later_wins(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(kmer, cnt) of both tables; where a k-mer is in both, the later count holds."""
    both = earlier.select("kmer", "cnt", F.lit(0).alias("turn")).unionByName(later.select("kmer", "cnt", F.lit(1).alias("turn")))
    return both.groupBy("kmer").agg(F.max_by("cnt", "turn").alias("cnt"))
