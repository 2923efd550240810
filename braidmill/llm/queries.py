"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import centroid_clusters
from .chat import rotate_perspectives
from .common import table
from .decontaminate import contamination
from .divergence import divergence_audit
from .jaccard import ngram_jaccard_join
from .knn import exact_top_k
from .license_scan import license_summary
from .mixing import mix_sources
from .quality import quality_scores
from .sharding import shard_documents
from .suffix_dedup import repeated_passages
from .token_counts import token_counts
from .url_filter import filter_urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; ``score`` is the classifier's. Edge cases as in ``filter_urls``."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of all documents in the mixture's global order. Edge cases as in ``mix_sources``."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    copy, copies, order = (F.col(c) for c in mixed.columns[-3:])
    return mixed.select("doc_id", "source", "text", copy.alias("copy"), copies.alias("copies"), order.alias("order_key"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and number of linked rows of every document. Edge cases as in ``ngram_jaccard_join``."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items found of every document. Edge cases as in ``contamination``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side; masks as ``start-stop`` with commas. Edge cases as in ``rotate_perspectives``."""
    rows = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return rows.select("conv_id", "speaker", "part", "offset", "n_turns", "n_own", "text", spans.alias("mask_spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases, labels and score of every document. Edge cases as in ``license_summary``."""
    return license_summary(table(spark, sf_dir, "documents"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. Edge cases as in ``shard_documents``."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every query vector. Edge cases as in ``exact_top_k``."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words and more that occur again. Edge cases as in ``repeated_passages``."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document. Edge cases as in ``quality_scores``."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of every language, and the terms it comes from. Edge cases as in ``divergence_audit``."""
    return divergence_audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. Edge cases as in ``token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of full width. Edge cases as in ``centroid_clusters``."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_mix_sources,
        op3_ngram_jaccard_join,
        op4_decontaminate,
        op5_chat_perspectives,
        op6_license_scan,
        op7_jump_sharding,
        op8_exact_top_k,
        op9_repeated_passages,
        op10_quality_classifier,
        op11_divergence_audit,
        op12_token_counts,
        op13_centroid_clusters,
    )
}
