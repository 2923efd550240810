"""Mergeable sketches of values: Bloom filters, saturating counters, distinct counts.

A filter is a table of packed buckets, some KB each, that partial aggregation
builds and that is merged with other filters by bucket.  Probes are tested by
JVM expressions against the packed buckets: in one broadcast row where the
filter's size, which is known beforehand, allows it, else by joins on the
bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidmill.session import materialize

from .kmers import times

#: Bits of a packed bucket, as the built-in bitmap functions have them; a counter takes a byte instead of a bit.
BUCKET = 32_768
#: Bytes of packed buckets that are broadcast as one row at most.
BROADCAST_BYTES = 64 << 20


class Shape(NamedTuple):
    """Cells of a filter (a multiple of ``BUCKET``) and hashes of each value."""

    cells: int
    hashes: int


def shape_for(values: int, rate: float) -> Shape:
    """The smallest filter that takes so many values for others with at most this rate."""
    if values < 0 or not 0 < rate < 1:
        raise ValueError(f"no filter for {values} values at a rate of {rate}")
    cells = math.ceil(-max(values, 1) * math.log(rate) / math.log(2) ** 2)
    cells = -(-cells // BUCKET) * BUCKET
    return Shape(cells, max(1, min(16, round(cells / max(values, 1) * math.log(2)))))


def expected_rate(values: int, shape: Shape) -> float:
    """The rate at which a filter of so many distinct values takes others for its own."""
    return (1 - math.exp(-shape.hashes * values / shape.cells)) ** shape.hashes


def _with_cells(values: DataFrame, column: str, shape: Shape) -> DataFrame:
    """values plus ``bm_cells``, the cells of each value: a half of its digest, to which the other is added again and again."""
    half = lambda at: (F.conv(F.substring("bm_digest", at, 15), 16, 10).cast("long") % shape.cells)
    rows = values.withColumn("bm_digest", F.md5(column)).withColumns({"bm_one": half(1), "bm_two": half(17)})
    cells = F.array(*[(F.col("bm_one") + i * F.col("bm_two")) % shape.cells for i in range(shape.hashes)])
    return rows.withColumn("bm_cells", cells).drop("bm_digest", "bm_one", "bm_two")


def bloom_filter(values: DataFrame, column: str, shape: Shape) -> DataFrame:
    """(bucket, bits): a Bloom filter of all values; buckets without a bit are left out, and so are nulls."""
    cell = _with_cells(values.select(column).where(F.col(column).isNotNull()), column, shape).select(F.explode("bm_cells").alias("cell"))
    return cell.groupBy(F.floor(F.col("cell") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("cell") % BUCKET).alias("bits"))


def merged_blooms(*filters: DataFrame) -> DataFrame:
    """(bucket, bits): the filter of all values of several filters of one shape."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _unpacked(table: DataFrame, packed: str) -> DataFrame:
    """(bucket, numbers): the packed bytes of each bucket as numbers, which expressions reach without a copy of the bucket."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [np.frombuffer(x.as_py(), np.uint8).astype(np.int16) for x in b[packed]]
            yield pa.RecordBatch.from_arrays([b["bucket"], pa.array(numbers, pa.list_(pa.int16()))], names=["bucket", "numbers"])

    return table.select("bucket", packed).mapInArrow(unpack, "bucket int, numbers array<smallint>")


def _level(numbers: Column, at: Column, bits: bool) -> Column:
    """What the cell at a place of its bucket holds, a bit or a counter; 0 where there is no bucket."""
    byte = F.coalesce(F.get(numbers, (F.floor(at / 8) if bits else at).cast("int")).cast("int"), F.lit(0))
    return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 if bits else byte


def _levels(values: DataFrame, column: str, table: DataFrame, packed: str, shape: Shape, bits: bool) -> DataFrame:
    """values plus ``level``, the least of what a value's cells hold; null for null."""
    numbers = _unpacked(table, packed)
    asked = F.col(column)
    if (shape.cells // 8 if bits else shape.cells) <= BROADCAST_BYTES:
        whole = numbers.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "numbers"))).alias("by_bucket"))
        every = F.sequence(F.lit(0), F.lit(shape.cells // BUCKET - 1))
        whole = whole.select(F.transform(every, lambda b: F.col("by_bucket")[b]).alias("bm_table"))
        level = lambda c: _level(F.get("bm_table", F.floor(c / BUCKET).cast("int")), c % BUCKET, bits)
        rows = _with_cells(values, column, shape).crossJoin(F.broadcast(whole))  # one row, of a size that the shape bounds
        least = F.when(asked.isNotNull(), F.array_min(F.transform("bm_cells", level)))
        return rows.withColumn("level", least).drop("bm_table", "bm_cells")
    cells = _with_cells(values.select(column).where(asked.isNotNull()).distinct(), column, shape).select(column, F.explode("bm_cells").alias("cell"))
    cells = cells.select(column, F.floor(F.col("cell") / BUCKET).cast("int").alias("bucket"), (F.col("cell") % BUCKET).alias("at")).join(numbers, "bucket", "left")
    least = cells.groupBy(column).agg(F.min(_level(F.col("numbers"), F.col("at"), bits)).alias("level"))
    return values.join(least, column, "left")


def with_membership(values: DataFrame, column: str, bloom: DataFrame, shape: Shape) -> DataFrame:
    """values plus ``held``: true for all values in the filter and, at its rate, for some others; null for null."""
    return _levels(values, column, bloom, "bits", shape, True).withColumn("held", F.col("level") == 1).drop("level")


def saturating_counters(values: DataFrame, column: str, shape: Shape, bits: int = 4) -> DataFrame:
    """(bucket, levels): counters of all occurrences, a byte for each, that stop at 15, 7, 3 or 1 (4 to 1 bits).

    A row with ``times`` counts as so many occurrences.  A value's least counter
    is never below its count (capped), and above only where all its cells are shared.  Tasks count in packed buckets, and these
    are added up as they stream in, so no cell is a row.
    """
    if bits not in (1, 2, 3, 4):
        raise ValueError(f"counters have 1 to 4 bits, not {bits}")
    top = (1 << bits) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            cells = b["cells"].flatten().to_numpy()
            each = np.repeat(np.minimum(b["times"].to_numpy(), top), shape.hashes)
            for bucket in np.unique(cells // BUCKET).tolist():
                own = cells // BUCKET == bucket
                hits = np.bincount(cells[own] % BUCKET, weights=each[own], minlength=BUCKET)
                held[bucket] = np.minimum(held.get(bucket, 0) + hits, top).astype(np.uint8)
        yield _buckets(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, levels in zip(b["bucket"].to_pylist(), b["levels"], strict=True):
                more = np.frombuffer(levels.as_py(), np.uint8)
                held[bucket] = np.minimum(held[bucket] + more, top).astype(np.uint8) if bucket in held else more  # two levels fit a byte
        yield _buckets(held)

    often = F.col("times").cast("long") if "times" in values.columns else F.lit(1).cast("long")
    rows = _with_cells(values.select(column, often.alias("times")).where(F.col(column).isNotNull()), column, shape).select(F.col("bm_cells").alias("cells"), "times")
    return rows.mapInArrow(count, "bucket int, levels binary").repartition("bucket").mapInArrow(add, "bucket int, levels binary")


def _buckets(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["bucket", "levels"])


def with_levels(values: DataFrame, column: str, counters: DataFrame, shape: Shape) -> DataFrame:
    """values plus ``level``: at least the value's capped count; null for null."""
    return _levels(values, column, counters, "levels", shape, False)


def occurring(values: DataFrame, column: str, counters: DataFrame, shape: Shape, times: int) -> DataFrame:
    """The values that the counters do not deny to occur so many times (at most what they can tell)."""
    return with_levels(values, column, counters, shape).where(F.col("level") >= times).drop("level")


def gated_counts(words: DataFrame, shape: Shape, least: int = 2) -> DataFrame:
    """(kmer, cnt) of the words seen at least ``least`` times, by two passes over ``words(kmer)``, or ``words(kmer, times)`` where equal reads have met before.

    The first pass sets what is seen and seen again in saturating counters; the
    second counts only words that may have been seen often enough, so words of
    reading errors, most of them seen once, are not shuffled.  Counts are
    exact: a word is let through in all its places or in none, and none that
    belongs to the result is held back.
    """
    if least < 1:
        raise ValueError(f"least is {least}, not 1 or more")
    bits = next((b for b in (1, 2, 3, 4) if (1 << b) - 1 >= least), 4)
    counters = materialize(saturating_counters(words, "kmer", shape, bits))
    passed = occurring(words, "kmer", counters, shape, min(least, (1 << bits) - 1))
    return passed.groupBy("kmer").agg(times(words).alias("cnt")).where(F.col("cnt") >= least)


def distinct_sketches(values: DataFrame, column: str, batch: str) -> DataFrame:
    """(batch, sketch): a mergeable sketch of the distinct values of each batch."""
    return values.groupBy(batch).agg(F.hll_sketch_agg(column).alias("sketch"))


def distinct_of(sketches: DataFrame) -> DataFrame:
    """(distinct_about): distinct values of all sketches together."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_about"))


def distinct_until_steady(batches: list[DataFrame], column: str, change: float = 0.05) -> DataFrame:
    """(batches, distinct_about, steady): batches are read one after another until the estimate moves by less than ``change``.

    ``batches`` is the number of those read.  Each is read at most once, and of
    it the driver holds one sketch of some KB.  No batches are an error.
    """
    if not batches:
        raise ValueError("no batches")
    spark, whole, before = batches[0].sparkSession, None, None
    for n, values in enumerate(batches, 1):
        own = values.agg(F.hll_sketch_agg(column).alias("sketch")).first()["sketch"]
        rows = spark.createDataFrame([(s,) for s in (whole, own) if s is not None], "sketch binary")
        merged = rows.agg(F.hll_union_agg("sketch").alias("sketch")).select("sketch", F.hll_sketch_estimate("sketch").alias("n")).first()
        whole, now = merged["sketch"], merged["n"]
        steady = before is not None and abs(now - before) < change * max(before, 1)
        if steady:
            break
        before = now
    return spark.createDataFrame([(n, now, steady)], "batches int, distinct_about long, steady boolean")
