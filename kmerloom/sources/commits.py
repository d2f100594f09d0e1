"""Appends and output sets that survive retries: rows are staged in a folder of their own and count from one atomic step on.

A library at ``path`` is its base, Parquet by category, and the appends under ``_appends`` that a record under ``_commits`` names. Spark passes over both folders when it
reads the base. A record is one file, so an append is there as a whole or not at all. Appends of one library are made one after another.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.session import file_system

LIBRARY = "category string, seq_id string, sequence string"


def committed(spark: SparkSession, path: str) -> list[str]:
    """The ids of the appends of a library, in order."""
    folder, fs = file_system(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    return [n.split("-", 1)[1] for n in names]


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """(category, seq_id, sequence): the base and all committed appends."""
    where, fs = file_system(spark, path)
    plain = [f for f in fs.listStatus(where) if not re.match(r"[._]", f.getPath().getName())] if fs.exists(where) else []
    out = spark.read.schema(LIBRARY).parquet(path) if plain else spark.createDataFrame([], LIBRARY)
    for one in committed(spark, path):
        out = out.unionByName(spark.read.schema(LIBRARY).parquet(f"{path}/_appends/{one}"))
    return out


def append(new: DataFrame, path: str, append_id: str) -> bool:
    """Adds (category, sequence) rows, named category_appended_N with N counting on from the category's committed size; whether they were new.

    An append whose id is committed is left out, so that a repeated call leaves one copy; what a call that failed has staged is written over. Rows are numbered in
    order of ``ord``, if there is one, and sequence, against the library as it is committed.
    """
    if not re.fullmatch(r"[A-Za-z0-9.]+", append_id):
        raise ValueError("an append's id has letters, digits and dots")
    spark = new.sparkSession
    done = committed(spark, path)
    if append_id in done:
        return False
    have = read_library(spark, path).groupBy("category").agg(F.count(F.lit(1)).alias("have"))
    order = Window.partitionBy("category").orderBy(*[c for c in ("ord", "sequence") if c in new.columns])
    named = new.withColumn("k", F.row_number().over(order)).join(have, "category", "left").withColumn("k", F.col("k") + F.coalesce("have", F.lit(0)))
    rows = named.select(F.concat(F.col("category"), F.lit("_appended_"), F.col("k")).alias("seq_id"), "sequence", "category")
    rows.write.mode("overwrite").partitionBy("category").parquet(f"{path}/_appends/{append_id}")
    record, fs = file_system(spark, f"{path}/_commits/{len(done):09d}-{append_id}")
    fs.mkdirs(record.getParent())
    fs.create(record, False).close()
    return True


def write_reads(reads: DataFrame, folder: str) -> bool:
    """FASTQ, FASTA and metadata of reads as one folder (reads.fastq, reads.fasta, reads_metadata.tsv); whether it was written.

    The three are staged beside it and come into being by one rename: together or not at all. A folder that is there is left as it is.
    """
    from kmerloom.sources import fasta

    spark = reads.sparkSession
    target, fs = file_system(spark, folder)
    if fs.exists(target):
        return False
    staged, _ = file_system(spark, f"{folder}._staged")
    fasta.write_reads(reads, f"{folder}._staged/reads", "overwrite")
    return bool(fs.rename(staged, target))
