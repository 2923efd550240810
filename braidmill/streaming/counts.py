"""Running k-mer counts over a stream of reads (the batch workflow has no stream of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidmill.functions import sequences as S


def stream_reads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of reads(seq) from a folder of Parquet files."""
    return spark.readStream.schema("seq string").parquet(path)


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmers(kmer, cnt) so far; for output modes complete and update."""
    segments = reads.select(F.explode(S.segments(F.upper("seq"))).alias("seq"))
    return segments.select(F.explode(S.kmer_array(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))
