"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables of this driver that are still there: path and the session's file system settings.
_written: list[tuple[str, object]] = []


@cache
def _own_folder() -> str:
    """A temporary folder for sessions on one machine that name no shared one."""
    folder = tempfile.mkdtemp(prefix="braidmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session that names none gets one of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder at which nothing lies yet; what is written there is removed like other tables."""
    path = f"{shared_dir(spark)}/braidmill-{uuid.uuid4().hex}"
    _written.append((path, spark._jsc.hadoopConfiguration()))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage.

    The table stays until ``settled`` or the end of the driver removes it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task gathers or sends on, about, where a table is dealt by its size.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about so many rows, by the columns in parts of ``TASK_ROWS``, so what a task holds does not grow with the table."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *by)


def held(df: DataFrame, rows: int, by: str) -> DataFrame:
    """``df``, of about so many rows, dealt and sorted by a column and kept on the disks of the executors, so that joins by it move the other side only.

    Whoever asks for it calls ``unpersist`` in the end.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, by).sortWithinPartitions(by).persist(StorageLevel.DISK_ONLY)


def numbered(df: DataFrame, rows: int, name: str, *order: Column) -> DataFrame:
    """``df``, of about so many rows, with each row's place from 1 in this order, which must be a total one; written once.

    Tasks sort ranges of it.  A row's place is its place in its range behind
    the rows of the ranges before, of which there is one small row each.
    """
    ranges = df.repartitionByRange(max(1, -(-rows // TASK_ROWS)), *order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn("bm_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("bm_id", 33), F.col("bm_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("bm_part")).agg(F.count("*").alias("n")).orderBy("bm_part").collect()
    before, seen = [], 0
    for r in sizes:
        before.append((r["bm_part"], seen))
        seen += r["n"]
    starts = df.sparkSession.createDataFrame(before, "bm_part long, bm_before long")
    out = placed.withColumns({"bm_part": part, "bm_inside": inside}).join(F.broadcast(starts), "bm_part")  # a row a range
    return out.select(*df.columns, (F.col("bm_before") + F.col("bm_inside") + 1).alias(name))


class Stepwise:
    """A table in the shared folder to which steps are added; its int column ``at`` is the folder a row lies in.

    Rows of one number are read without those of the others.
    """

    def __init__(self, spark: SparkSession, schema: str, at: str = "layer"):
        self.spark, self.at = spark, at
        self.path = new_path(spark)
        self.schema = spark.createDataFrame([], f"{schema}, {at} int").schema
        self._place(self.path).mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))

    def _place(self, path: str):  # the file system, a JVM object
        return self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").partitionBy(self.at).parquet(self.path)

    def put(self, rows: DataFrame, number: int) -> None:
        """Add rows that all have one number, which spares the sort by it."""
        rows.select(*[name for name in self.schema.names if name != self.at]).write.mode("append").parquet(f"{self.path}/{self.at}={int(number)}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def step(self, number: int) -> DataFrame:
        """The rows of one number, without the column of it; no other folder is looked at."""
        schema = StructType([f for f in self.schema.fields if f.name != self.at])
        if not self.has(number):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.at}={int(number)}")

    def has(self, number: int) -> bool:
        """Whether rows of this number were added."""
        folder = f"{self.path}/{self.at}={int(number)}"
        return self._place(folder).exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder))

    def drop(self, number: int) -> None:
        """Remove the rows of one number, which nothing reads any more."""
        _remove([(f"{self.path}/{self.at}={int(number)}", self.spark._jsc.hadoopConfiguration())])


def bookmark() -> int:
    """How many tables there are; ``settled`` removes those written after it."""
    return len(_written)


def settled(df: DataFrame, since: int) -> DataFrame:
    """Materialize ``df``, then remove the tables written since the bookmark, from which it was made."""
    out = materialize(df)
    _remove(_written[since:-1])
    del _written[since:-1]
    return out


def forget(since: int, keep: int) -> None:
    """Remove the tables written since the bookmark, but for the last ``keep``."""
    end = len(_written) - keep
    _remove(_written[since:end])
    del _written[since:end]


def _remove(tables: list[tuple[str, object]]) -> None:
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    for path, conf in tables:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _remove_all() -> None:
    try:
        _remove(_written)
    except (Py4JError, OSError, AttributeError):  # the JVM has gone already
        pass
    _written.clear()
