"""Sequence and taxonomy files as DataFrames: FASTA, FASTQ, taxonomy and rank tables, and their writers."""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions.dna import safe_name
from kmerloom.sources import formats


def exists(path: str) -> bool:
    """Whether a path has a file or folder, asked of its own file system."""
    fs, inner = formats.opened(path)
    return fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound


def read(spark: SparkSession, form: str, path: str, **options) -> DataFrame:
    """Rows of one of the :mod:`kmerloom.sources.formats`."""
    formats.register(spark)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format(form).options(**given).load(path)


def read_fasta(spark: SparkSession, path: str, header: str = "full", keep_empty: bool = False, glob: str | None = None, range_bytes: int | None = None) -> DataFrame:
    """(seq_id, description, sequence, file, ord).

    Records begin where a line begins with '>'; large files are read in byte ranges by many tasks. ``header``: 'full' (the whole
    line is the id), 'token' (the first word), 'colon' (what is before the first ':' of the first word), 'lineage' (id up to the
    first space, the rest in description). Records with an empty sequence are dropped unless ``keep_empty``. A missing path gives no rows.
    """
    rows = read(spark, "fasta", path, glob=glob, rangeBytes=range_bytes)
    head, word = F.col("header"), F.element_at(F.split(F.trim("header"), r"\s+"), 1)
    seq_id: Column = {"full": head, "token": word, "colon": F.substring_index(word, ":", 1), "lineage": F.substring_index(head, " ", 1)}[header]
    description = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"^\S* ", "")).otherwise(F.lit(""))
    out = rows.select(seq_id.alias("seq_id"), description.alias("description"), "sequence", "file", "ord")
    return out if keep_empty else out.where(F.length("sequence") > 0)


def last_by_id(df: DataFrame) -> DataFrame:
    """Of records with one id the last stays, at the place of the first."""
    return df.groupBy("seq_id").agg(F.max_by("sequence", "ord").alias("sequence"), F.min("ord").alias("ord"))


def read_category(library: DataFrame, category: str) -> DataFrame:
    """Sequences of one category (pruned if the library is partitioned by it)."""
    return library.where(F.col("category") == category)


def read_fastq(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(read_id, sequence, quality, ord); four lines per record, '@' stripped; a file cut off within a record raises."""
    return read(spark, "fastq", path, rangeBytes=range_bytes).select("read_id", "sequence", "quality", "ord")


def read_taxonomy_index(spark: SparkSession, path: str, header: bool = True, strict: bool = False) -> DataFrame:
    """(seq_id, lowest, lineage, ord): three tab-separated parts, the third is the rest of the line.

    ``header`` skips the first line of each file; blank lines are skipped; ``strict`` raises on fewer than three parts.
    """
    return read(spark, "taxonomy_index", path, header=header, strict=strict).select("seq_id", "lowest", "lineage", "ord")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, lineage): two parts at the first tab, no header; a repeated id keeps its last line, in order of file names and lines; a line without tab raises."""
    lines = read(spark, "numbered_lines", path).select(F.split(F.regexp_replace("value", r"\s+$", ""), "\t", 2).alias("p"), "ord")
    value = F.coalesce(F.get("p", F.lit(1)), F.raise_error(F.lit("taxonomy line without a tab")).cast("string"))
    return lines.select(F.get("p", F.lit(0)).alias("seq_id"), value.alias("lineage"), "ord").groupBy("seq_id").agg(F.max_by("lineage", "ord").alias("lineage"))


def read_rank_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(path, rank) from columns 0 and 2 of a tab-separated file; shorter lines are skipped, the last of equal paths wins, in order of file names and lines."""
    lines = read(spark, "numbered_lines", path).select(F.split("value", "\t").alias("p"), "ord").where(F.size("p") >= 3)
    trimmed = lines.select(F.trim(F.get("p", F.lit(0))).alias("path"), F.trim(F.get("p", F.lit(2))).alias("rank"), "ord")
    return trimmed.groupBy("path").agg(F.max_by("rank", "ord").alias("rank"))


def category_files(spark: SparkSession, folder: str, prefix: str = "s__") -> DataFrame:
    """(category) of the FASTA files, or folders of part files, in a folder whose names start with the prefix, sorted."""
    fs, inner = formats.opened(folder)
    names = sorted(f.base_name.removesuffix(".fasta") for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.base_name.startswith(prefix) and f.base_name.endswith(".fasta"))
    return spark.createDataFrame([(n,) for n in names], "category string")


def fasta_line(seq_id: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), seq_id, F.lit("\n"), sequence)


def write_fasta(df: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "sequence", mode: str = "errorifexists") -> None:
    df.select(fasta_line(F.col(id_col), F.col(seq_col)).alias("value")).write.mode(mode).text(path)


def write_library(library: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(category, seq_id, sequence) as Parquet by category; with 'overwrite' only the categories written are replaced."""
    out = library.select("seq_id", "sequence", "category").repartition("category")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("category").parquet(path)


def write_bucketed_fasta(library: DataFrame, path: str, mode: str = "overwrite") -> None:
    """FASTA text files in one folder per category (named as a safe file name)."""
    rows = library.select(fasta_line(F.col("seq_id"), F.col("sequence")).alias("value"), safe_name(F.col("category")).alias("category"))
    rows.write.mode(mode).partitionBy("category").text(path)


def append_sequences(library: DataFrame, new: DataFrame, path: str | None = None) -> DataFrame:
    """The library with new (category, sequence) rows, named category_appended_N with N counting on from the category's size."""
    have = library.groupBy("category").agg(F.count(F.lit(1)).alias("have"))
    order = Window.partitionBy("category").orderBy(*[c for c in ("ord", "sequence") if c in new.columns])
    named = new.join(have, "category", "left").withColumn("k", F.row_number().over(order) + F.coalesce("have", F.lit(0)))
    added = named.select("category", F.concat(F.col("category"), F.lit("_appended_"), F.col("k")).alias("seq_id"), "sequence")
    if path:
        added.select("seq_id", "sequence", "category").write.mode("append").partitionBy("category").parquet(path)
    return library.select("category", "seq_id", "sequence").unionByName(added)


def write_taxonomy_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines id, lowest, lineage, with tabs and without a header."""
    index.select(F.concat_ws("\t", "seq_id", "lowest", "lineage").alias("value")).write.mode(mode).text(path)


def write_reads(reads: DataFrame, prefix: str, mode: str = "errorifexists") -> None:
    """FASTQ, FASTA and metadata (with header) of (read_id, sequence, quality, taxonomy, template_id, orig_len, final_len)."""
    reads.select(F.concat(F.lit("@"), F.col("read_id"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality")).alias("value")).write.mode(mode).text(f"{prefix}.fastq")
    write_fasta(reads, f"{prefix}.fasta", "read_id", "sequence", mode)
    reads.select("read_id", "taxonomy", "template_id", "orig_len", "final_len").write.mode(mode).option("sep", "\t").option("header", True).csv(f"{prefix}_metadata.tsv")
