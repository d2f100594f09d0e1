"""Session helpers of the engine: the shared folder, stored intermediates, package reach of the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster ships it with ``--py-files``."""
    root = str(Path(__file__).resolve().parent.parent)
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [have])])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where it is unset (local runs and tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not path and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def file_system(spark: SparkSession, path: str):
    """A path as the file system's own object, and that file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write as Parquet into the shared folder, with a folder for each value of ``by``, and read back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly if the scan has fewer splits than there are cores (a small or unsplittable file), else as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def lean_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """For queries, not operators: hand Python workers small batches, whose memory does not grow with the table."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def numbered(df: DataFrame, key: str | None, order: list[str], name: str) -> DataFrame:
    """All columns and ``name``: the place, from 0, of each row among those of its key (of all rows without a key) in the given order.

    One range-partitioned sort; rows are numbered within each range and the (few) rows of a key in earlier ranges are added, so that
    a key with most rows is spread over many tasks. Rows that are equal in the order are numbered in any order.
    """
    first = [key] if key else []
    n = shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *first, *order).sortWithinPartitions(*first, *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            start = np.zeros(size, np.int64)
            if key:
                values = np.array(batch.column(key).to_pylist(), object)
                new = np.flatnonzero(values[1:] != values[:-1]) + 1
                at = at if last is not None and values[0] == last[0] else 0
                start[new] = new
                start = np.maximum.accumulate(start)
                last = (values[-1],)
            place = np.arange(size) - start + np.where(start == 0, at, 0)
            at = int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(size, part, np.int32))], [*batch.schema.names, "_local", "_part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    local = stored(placed.mapInArrow(number, f"{fields}, _local bigint, _part int"), "numbered")
    counts = local.groupBy(*first, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*first).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias("_key") for k in first], F.col("_part").alias("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_range")
    joined = local.join(offsets, (F.col(key).eqNullSafe(F.col("_key")) & on) if key else on)
    return joined.select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))
