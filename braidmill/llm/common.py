"""Shared pieces: tables, lower-casing, summed tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from braidmill.operators.components import connected_components
from braidmill.session import materialize, shared_dir

from .textops import release_memory

__all__ = ["bitmap", "connected_components", "extended", "free_name", "lower_ascii", "materialize", "quoted", "shared_dir", "summed_table", "table"]

_SLICES = 16
#: Arrays that one task adds up.
_FAN_IN = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it while some column is called so (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its plain name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def extended(schema: StructType, **more: str) -> StructType:
    """A new schema with further fields, by name and type."""
    return StructType([*schema.fields, *(StructField(n, _parse_datatype_string(t)) for n, t in more.items())])


def lower_ascii(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def summed_table(df: DataFrame, size: int, fill: Callable[[np.ndarray, pa.RecordBatch], None], dtype: str = "int64") -> np.ndarray:
    """Sum of one fixed-size array per partition of ``df``, over all its rows.

    ``fill(total, batch)`` adds a batch.  Each task sends its array in slices,
    compressed; the slices are added up as they stream in, by as many levels
    as it takes for a task to add ``_FAN_IN`` of them at most.
    """
    step = -(-size // _SLICES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=dtype)
        for b in batches:
            fill(total, b)
        blobs = [_pack(total[k * step : (k + 1) * step]) for k in range(_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b["slice"].to_pylist(), b["blob"], strict=True):
                part = _unpack(blob.as_py(), dtype)
                sums[k] = sums[k] + part if k in sums else part
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([_pack(sums[k]) for k in keys], pa.binary())], names=["slice", "blob"])

    schema = "slice int, blob binary"
    sums, parts = df.mapInArrow(partial, schema), df.rdd.getNumPartitions()
    while parts > _FAN_IN:
        parts = -(-parts // _FAN_IN)
        sums = sums.withColumn("part", F.spark_partition_id() % parts).repartition(_SLICES * parts, "slice", "part").drop("part").mapInArrow(add, schema)
    rows = sums.repartition(_SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros(size, dtype=dtype)
    for r in rows:
        part = _unpack(bytes(r["blob"]), dtype)
        out[r["slice"] * step : r["slice"] * step + len(part)] = part
    return out


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits, one set for the leading ``bits`` bits of every hash in a long column."""
    size = (1 << bits) // _SLICES // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            place = (b["h"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for k in np.unique(place // (size * 8)).tolist():
                at = place[place // (size * 8) == k] - k * size * 8
                np.bitwise_or.at(found.setdefault(k, np.zeros(size, np.uint8)), at >> 3, (128 >> (at & 7)).astype(np.uint8))
        keys = sorted(found)
        blobs = [zlib.compress(found[k].tobytes(), 1) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])

    h = df.select(F.col(column).alias("h"), F.shiftrightunsigned(column, 60).alias("slice"))
    out = np.zeros(size * _SLICES, np.uint8)
    for r in h.repartition(_SLICES, "slice").mapInArrow(build, "slice int, blob binary").collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] |= np.frombuffer(zlib.decompress(bytes(r["blob"])), np.uint8)
    return out


def in_bitmap(packed: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    place = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[place >> 3] & (128 >> (place & 7)).astype(np.uint8)) > 0


def _pack(a: np.ndarray) -> bytes:
    if a.dtype.kind == "i":  # small counts fit a narrower type
        top = max(-int(a.min()), int(a.max())) if len(a) else 0
        kind = next(k for k in ("int8", "int16", "int32", "int64") if top <= np.iinfo(k).max)
        return kind[3:].encode().ljust(2) + zlib.compress(a.astype(kind).tobytes(), 1)
    return b"f " + zlib.compress(a.tobytes(), 1)


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    kind = blob[:2].decode().strip()
    return np.frombuffer(zlib.decompress(blob[2:]), dtype=dtype if kind == "f" else f"int{kind}").astype(dtype)
