"""The corpus pipeline: five stages over ``documents``, each an operator of ``kmerloom.llm``.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of documents.

Defined results, as the operators state them: null and empty texts are clean, lose no line, are linked with nothing, hold no
benchmark window and are mixed with size 0; texts of any length are read whole; repeated rows are one document after the third
stage; ties go to the least doc_id, then to a hash of the text; null columns stay null; empty tables give empty results. Further columns
pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from kmerloom.llm._common import lean_batches, remove, scratch, table, work_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go."""
    lean_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model).where("not toxic").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; all documents stay."""
    lean_batches(spark)
    out = line_dedup.line_dedup(docs).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity 0.8)."""
    lean_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    lean_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target and taken."""
    lean_batches(spark)
    return mixing.mix(docs).select("row.*", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The learned first stage has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's intermediates are removed once its result is written, and its input if a stage wrote that.

    What the last stage reads stays, as the result is lazy.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
