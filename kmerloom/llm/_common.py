"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kmerloom-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder for one run of ``what`` inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What the innermost open ``scratch`` block of a thread has made: folders, and tables kept on the executors' disks.
_threads = threading.local()


def _made() -> list[tuple[list[str], list[DataFrame]]]:
    if not hasattr(_threads, "made"):
        _threads.made = []
    return _threads.made


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates made within the block go at its end: stored folders are removed, kept tables let go.

    For programs: whatever is to last must be written before the block ends, as results are lazy.
    """
    _made().append(([], []))
    try:
        yield
    finally:
        folders, tables = _made().pop()
        for df in tables:
            df.unpersist()
        for folder in folders:
            remove(spark, folder)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there."""
    path = work_dir(df.sparkSession, what)
    if _made():
        _made()[-1][0].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Keep a wide table that is read several times on the executors' disks.

    The lineage stays, so the part of a lost executor is computed again. Small tables that end a lineage are ``stored``.
    """
    if _made():
        _made()[-1][1].append(df)
    return df.persist(StorageLevel.DISK_ONLY)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(df: DataFrame, *cols: Column) -> int:
    """Total bytes of some string or binary columns, summed by the executors."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 8 for c in cols), F.lit(0))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()[0]


def is_small(df: DataFrame, most_rows: int = 200_000) -> bool:
    """Whether a stored table has few rows. For tables of a few short columns, so that rows bound the bytes."""
    return df.limit(most_rows + 1).count() <= most_rows


def small(df: DataFrame, most_rows: int = 200_000):
    """``F.broadcast`` if a stored table of short rows is small, else nothing (the join then shuffles, and AQE splits skew)."""
    return F.broadcast if is_small(df, most_rows) else lambda x: x


def lean_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """For programs (queries, pipelines), not operators: hand Python workers small batches, for less memory on both sides."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
