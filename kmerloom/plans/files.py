"""Queries over sources, sinks and inductors: a small set of files is written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions import dna, lineage
from kmerloom.operators import encode, identify, induct
from kmerloom.plans.catalog import LINEAGES_SQL, WHOLE_SQL, documents_dna, lineages, query, table, whole_dna
from kmerloom.session import shared_dir
from kmerloom.sources import commits, fasta


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{what}-{uuid.uuid4().hex}"


def _md5(column: str):
    return F.md5(F.col(column).cast("binary"))


_DNA = f"(SELECT doc_id, lang, {WHOLE_SQL} AS s FROM documents)"


def _header(df: DataFrame, form):
    return df.withColumn("seq_id", form)


@query(f"SELECT 'd' || doc_id || ' kind A->B; > x' AS seq_id, md5(s) AS sequence_md5 FROM {_DNA} WHERE s <> ''")
def file_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole header lines as ids, with '>' inside of headers; empty sequences go."""
    path = folder(spark, "fasta")
    fasta.write_fasta(_header(documents_dna(spark, sf_dir), F.concat(F.lit("d"), "doc_id", F.lit(" kind A->B; > x"))), path)
    return fasta.read_fasta(spark, path).select("seq_id", _md5("sequence").alias("sequence_md5"))


@query(f"SELECT 'd' || doc_id AS seq_id, length(s)::BIGINT AS n_bases FROM {_DNA}")
def file_fasta_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words as ids; empty sequences stay."""
    path = folder(spark, "token")
    fasta.write_fasta(_header(documents_dna(spark, sf_dir), F.concat(F.lit("d"), "doc_id", F.lit(" some words"))), path)
    return fasta.read_fasta(spark, path, "token", keep_empty=True).select("seq_id", F.length("sequence").cast("bigint").alias("n_bases"))


@query(f"SELECT 'tpl' || doc_id AS seq_id, length(s)::BIGINT AS n_bases FROM {_DNA} WHERE s <> ''")
def file_fasta_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to the first colon."""
    path = folder(spark, "colon")
    fasta.write_fasta(_header(documents_dna(spark, sf_dir), F.concat(F.lit("tpl"), "doc_id", F.lit(":7:x words"))), path)
    return fasta.read_fasta(spark, path, "colon").select("seq_id", F.length("sequence").cast("bigint").alias("n_bases"))


@query(f"SELECT 'd' || doc_id AS seq_id, 'Bacteria;' || doc_id || ';A B' AS description, md5(s) AS sequence_md5 FROM {_DNA} WHERE s <> ''")
def file_fasta_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and lineage of a header."""
    path = folder(spark, "lineage")
    fasta.write_fasta(_header(documents_dna(spark, sf_dir), F.concat(F.lit("d"), "doc_id", F.lit(" Bacteria;"), "doc_id", F.lit(";A B"))), path)
    return fasta.read_fasta(spark, path, "lineage").select("seq_id", "description", _md5("sequence").alias("sequence_md5"))


@query(f"SELECT 'd' || (doc_id % 50) AS seq_id, arg_max(md5(s), doc_id) AS sequence_md5 FROM {_DNA} GROUP BY doc_id % 50")
def file_last_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of records with one id the last stays."""
    path = folder(spark, "last")
    rows = documents_dna(spark, sf_dir).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")  # files in order of ids
    fasta.write_fasta(_header(rows, F.concat(F.lit("d"), F.col("doc_id") % 50)), path)
    return fasta.last_by_id(fasta.read_fasta(spark, path, keep_empty=True)).select("seq_id", _md5("sequence").alias("sequence_md5"))


@query(f"""
WITH d AS (SELECT doc_id, s FROM {_DNA}), k AS (SELECT doc_id, substr(s, i::BIGINT, 5) AS x FROM (SELECT doc_id, s, unnest(range(1, length(s) - 3)) AS i FROM d WHERE length(s) >= 5))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_kmers, (SELECT count(DISTINCT s) FROM d)::BIGINT AS n_first, 0::BIGINT AS n_again FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM k WHERE regexp_full_match(x, '[ACGT]{{5}}') GROUP BY doc_id) USING (doc_id)
""")
def encoded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded through a store, twice: the second run encodes nothing."""
    path = folder(spark, "encoded")
    docs = documents_dna(spark, sf_dir)
    _, first = encode.encode_through(docs, path, buckets=8)
    rows, again = encode.encode_through(docs, path, buckets=8)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_kmers"), F.lit(first).cast("bigint").alias("n_first"), F.lit(again).cast("bigint").alias("n_again"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", whole_dna(F.coalesce("text", F.lit(""))).alias("sequence")).where("sequence <> ''")
    n = F.length("sequence")
    return items.select(F.concat(F.lit("read_"), "item_id").alias("read_id"), "sequence", F.repeat(F.lit("I"), n).alias("quality"), F.lit("k__A; s__B").alias("taxonomy"), F.concat(F.lit("t"), "item_id").alias("template_id"), (n + 1).alias("orig_len"), n.alias("final_len"))


_READS = f"(SELECT item_id, {WHOLE_SQL} AS s FROM benchmark)"


@query(f"SELECT 'read_' || item_id AS read_id, md5(s) AS sequence_md5, length(s)::BIGINT AS n_quality FROM {_READS} WHERE s <> ''")
def file_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "reads")
    fasta.write_reads(_reads(spark, sf_dir), path)
    return fasta.read_fastq(spark, f"{path}.fastq").select("read_id", _md5("sequence").alias("sequence_md5"), F.length("quality").cast("bigint").alias("n_quality"))


@query(f"SELECT 'read_' || item_id AS read_id, 'k__A; s__B' AS taxonomy, 't' || item_id AS template_id, (length(s) + 1)::BIGINT AS orig_len, length(s)::BIGINT AS final_len, md5(s) AS sequence_md5 FROM {_READS} WHERE s <> ''")
def file_reads_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulator's FASTA and metadata table, joined."""
    path = folder(spark, "metadata")
    commits.write_reads(_reads(spark, sf_dir), path)
    meta = spark.read.option("sep", "\t").option("header", True).schema("read_id string, taxonomy string, template_id string, orig_len bigint, final_len bigint").csv(f"{path}/reads_metadata.tsv")
    return meta.join(fasta.read_fasta(spark, f"{path}/reads.fasta").select(F.col("seq_id").alias("read_id"), _md5("sequence").alias("sequence_md5")), "read_id")


_LOWEST = "list_filter(list_transform(string_split(lineage, ';'), lambda x: trim(x)), lambda x: contains(x, '__') AND NOT ends_with(x, '__'))[-1]"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineages(spark, sf_dir).select("seq_id", lineage.lowest_rank(F.col("lineage")).alias("lowest"), "lineage")


@query(f"SELECT seq_id::VARCHAR AS seq_id, {_LOWEST} AS lowest, lineage FROM ({LINEAGES_SQL})")
def file_taxonomy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "index")
    fasta.write_taxonomy_index(_index(spark, sf_dir), path)
    return fasta.read_taxonomy_index(spark, path, header=False, strict=True).select("seq_id", "lowest", "lineage")


@query(f"SELECT seq_id::VARCHAR AS seq_id, {_LOWEST} AS lowest, lineage FROM ({LINEAGES_SQL})")
def file_taxonomy_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan that leaves out the first line of each of many files, a header here."""
    path = folder(spark, "scan")
    _index(spark, sf_dir).repartition(5, "seq_id").write.option("sep", "\t").option("header", True).csv(path)
    return fasta.read_taxonomy_index(spark, path).select("seq_id", "lowest", "lineage")


@query(f"SELECT (seq_id % 100)::VARCHAR AS seq_id, arg_max(lineage, seq_id) AS lineage FROM ({LINEAGES_SQL}) GROUP BY seq_id % 100")
def file_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns; of a repeated id the last line stays."""
    path = folder(spark, "taxonomy")
    rows = lineages(spark, sf_dir).repartitionByRange(8, "seq_id").sortWithinPartitions("seq_id")  # files in order of ids
    rows.select(F.concat_ws("\t", F.col("seq_id") % 100, "lineage").alias("value")).write.text(path)
    return fasta.read_taxonomy(spark, path)


@query("SELECT 'Bacteria;' || r_name || ';' || n_name || ';' AS path, 'class' AS rank FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns 0 and 2; short lines are skipped."""
    path = folder(spark, "ranks")
    _nations(spark, sf_dir).select(F.concat(F.lit("Bacteria;"), "r_name", F.lit(";"), "n_name", F.lit(";\t7\tclass\tx")).alias("value")).union(spark.range(2).select(F.lit("short\tline").alias("value"))).write.text(path)
    return fasta.read_rank_lookup(spark, path).select("path", "rank")


@query("SELECT 's__' || r_name AS category, count(*)::BIGINT AS n_sequences FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of a folder by the names of its FASTA files, and how many sequences each file has; another prefix and a missing file have none."""
    path = folder(spark, "categories")
    rows = _nations(spark, sf_dir)
    for r in table(spark, sf_dir, "region").select("r_name").collect():
        own = rows.where(F.col("r_name") == r.r_name)
        for prefix in ("s__", "g__"):
            fasta.write_fasta(own.select(F.col("n_name").alias("seq_id"), F.lit("ACGT").alias("sequence")), f"{path}/{prefix}{r.r_name}.fasta")
    found = None
    for c in [*fasta.category_files(spark, path).collect(), ("s__missing",)]:
        own = fasta.read_fasta(spark, f"{path}/{c[0]}.fasta").select(F.lit(c[0]).alias("category"))
        found = own if found is None else found.union(own)
    return found.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("n_sequences"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_dna(spark, sf_dir).select(F.concat(F.lit("s__a b/"), F.col("doc_id") % 7).alias("category"), F.concat(F.lit("d"), "doc_id").alias("seq_id"), "sequence").where("sequence <> ''")


@query(f"SELECT 's__a_b_' || (doc_id % 7) AS category, 'd' || doc_id AS seq_id, md5(s) AS sequence_md5 FROM {_DNA} WHERE s <> ''")
def file_bucketed_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA by category under file-safe names, each folder read by itself."""
    path = folder(spark, "buckets")
    fasta.write_bucketed_fasta(_library(spark, sf_dir), path)
    found = None
    for k in range(7):
        name = f"s__a_b_{k}"
        own = fasta.read_fasta(spark, f"{path}/category={name}").select(F.lit(name).alias("category"), "seq_id", _md5("sequence").alias("sequence_md5"))
        found = own if found is None else found.union(own)
    return found


@query(f"SELECT 'd' || doc_id AS seq_id, md5(s) AS sequence_md5 FROM {_DNA} WHERE s <> '' AND doc_id % 7 = 3")
def file_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category of a stored library, by partition pruning."""
    path = folder(spark, "library")
    fasta.write_library(_library(spark, sf_dir), path)
    return fasta.read_category(spark.read.parquet(path), "s__a b/3").select("seq_id", _md5("sequence").alias("sequence_md5"))


@query(f"""
WITH d AS (SELECT 'c' || (doc_id % 7) AS category, doc_id, s FROM {_DNA} WHERE s <> ''),
have AS (SELECT category, count(*) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY category)
SELECT category, 'd' || doc_id AS seq_id, md5(s) AS sequence_md5 FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT category, category || '_appended_' || (coalesce(n, 0) + row_number() OVER (PARTITION BY category ORDER BY doc_id)), md5(s) FROM d LEFT JOIN have USING (category) WHERE doc_id % 2 = 1
""")
def file_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids appended to those with even ids, in the stored library."""
    rows = documents_dna(spark, sf_dir).where("sequence <> ''").select(F.concat(F.lit("c"), F.col("doc_id") % 7).alias("category"), F.concat(F.lit("d"), "doc_id").alias("seq_id"), "sequence", F.col("doc_id").alias("ord"))
    path = folder(spark, "append")
    library = rows.where("ord % 2 = 0").drop("ord")
    fasta.write_library(library, path)
    for _ in range(2):  # the second call is a retry
        commits.append(rows.where("ord % 2 = 1").drop("seq_id"), path, "odd")
    return commits.read_library(spark, path).select("category", "seq_id", _md5("sequence").alias("sequence_md5"))


@query(f"""
SELECT seq_id || ':' || CASE WHEN seq_id % 3 = 0 THEN '' ELSE array_to_string(list_transform(t, lambda x: ' ' || x || ' (' || format('{{:g}}', (length(x) - 7) / (7.0::DOUBLE * power(10, seq_id % 8 - 1))) || ')'), '') END AS line
FROM (SELECT seq_id, list_filter(list_transform(string_split(lineage, ';'), lambda x: trim(x)), lambda x: contains(x, '__') AND NOT ends_with(x, '__')) AS t FROM ({LINEAGES_SQL}))
UNION ALL SELECT '' UNION ALL SELECT 'RESULTS'
""")
def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of classification results; an early exit has an empty path."""
    path = folder(spark, "results")
    ranks = lineage.all_ranks(F.col("lineage"))
    score = lambda x: (F.length(x) - 7) / (F.lit(7.0) * F.pow(F.lit(10.0), F.col("seq_id") % 8 - 1))
    found = lineages(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), ranks.alias("path"), F.transform(ranks, score).alias("path_scores"), F.when(F.col("seq_id") % 3 == 0, "EARLY_EXIT").otherwise("COMPLETE").alias("status"))
    identify.write_results(found, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_NODES = f"SELECT DISTINCT unnest(list_filter(list_transform(string_split(lineage, ';'), lambda x: trim(x)), lambda x: contains(x, '__') AND NOT ends_with(x, '__'))) AS node FROM ({LINEAGES_SQL})"


@query(f"""
WITH l AS (SELECT {_LOWEST} AS lowest, count(*)::BIGINT AS n FROM ({LINEAGES_SQL}) GROUP BY 1)
SELECT node, translate(node, ' /()', '__') AS safe_name, coalesce(n, 0)::BIGINT AS n_sequences FROM ({_NODES}) LEFT JOIN l ON lowest = node
""")
def induct_pairs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA file and a taxonomy file to nodes, with and without sequences."""
    path = folder(spark, "pairs")
    rows = lineages(spark, sf_dir)
    fasta.write_fasta(rows.select(F.concat("seq_id", F.lit(" more")).alias("seq_id"), F.lit("ACGTACGT").alias("sequence")), f"{path}/x.fasta")
    rows.select(F.concat_ws("\t", "seq_id", "lineage").alias("value")).write.text(f"{path}/taxonomy.tsv")
    return induct.induct_two_files(spark, f"{path}/x.fasta", f"{path}/taxonomy.tsv").nodes


_CUSTOMERS = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""
WITH p AS (SELECT c_custkey AS id, r_name, n_name, CASE WHEN c_custkey % 5 = 0 THEN 'unidentified' ELSE c_mktsegment END AS sp {_CUSTOMERS} WHERE c_custkey % 4 <> 1),
x AS (SELECT id::VARCHAR AS seq_id, 'k__Bacteria;p__' || r_name || ';c__' || n_name || CASE WHEN sp = 'unidentified' THEN '' ELSE ';s__' || sp END AS lineage FROM p)
SELECT seq_id, string_split(lineage, ';')[-1] AS lowest, lineage FROM x
""")
def induct_headers_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA file with lineages in its headers and a table of ranks to the taxonomy index; only bacteria stay."""
    path = folder(spark, "headers")
    c, n = table(spark, sf_dir, "customer"), _nations(spark, sf_dir)
    species = F.when(F.col("c_custkey") % 5 == 0, F.lit("unidentified")).otherwise(F.col("c_mktsegment"))
    kingdom = F.when(F.col("c_custkey") % 4 == 1, F.lit("Archaea")).otherwise(F.lit("Bacteria"))
    header = F.concat(F.col("c_custkey").cast("string"), F.lit(" "), kingdom, F.lit(";"), "r_name", F.lit(";"), "n_name", F.lit(";"), species)
    fasta.write_fasta(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(header.alias("seq_id"), F.lit("ACGT").alias("sequence")), f"{path}/x.fasta")
    region = n.select(F.concat(F.lit("Bacteria;"), "r_name", F.lit(";\t1\tphylum")).alias("value")).distinct()
    region.union(n.select(F.concat(F.lit("Bacteria;"), "r_name", F.lit(";"), "n_name", F.lit(";\t2\tclass")).alias("value"))).write.text(f"{path}/ranks.tsv")
    return induct.induct_headers(spark, f"{path}/x.fasta", f"{path}/ranks.tsv").index.select("seq_id", "lowest", "lineage")


@query(f"SELECT c_custkey AS seq_id, starts_with(path, 'Bacteria;') AS bacterial, ((strpos('ACGT', k[1]) - 1) * 64 + (strpos('ACGT', k[2]) - 1) * 16 + (strpos('ACGT', k[3]) - 1) * 4 + strpos('ACGT', k[4]) - 1)::INT AS code FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Bacteria;' ELSE 'Archaea;Bacteria;' END || n_name AS path, substr('ACGTTGCAACCGGTTA', (c_custkey % 12)::INT + 1, 4) AS k {_CUSTOMERS})")
def bacterial_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on bacteria, and packed numbers of short strings."""
    rows = table(spark, sf_dir, "customer").join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("Bacteria;")).otherwise(F.lit("Archaea;Bacteria;")), "n_name")
    kmer = F.substring(F.lit("ACGTTGCAACCGGTTA"), (F.col("c_custkey") % 12 + 1).cast("int"), F.lit(4))
    return rows.select(F.col("c_custkey").alias("seq_id"), lineage.is_bacterial(path).alias("bacterial"), dna.kmer_code(kmer).alias("code"))
