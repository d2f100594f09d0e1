"""Line dedup by site-relative frequency (DataFrame functions only).

Per host, a line's frequency is the number of the host's pages with the line over all pages of the host. A line is boilerplate, and is dropped from the
host's pages, if its frequency exceeds ``ratio`` for certain: if the lower bound of Wilson's interval, ``Z`` standard errors wide, does. So one ratio
decides on hosts of any size: 3 of 50 pages exceed it, 12 of 500, 250 of 20,000. On hosts of fewer than 50 pages ``LEAST`` pages are needed besides, as
there one or two of them would do. Lines are split at ``\\n`` and compared whole (by 128 bits of hashes, so that no line text
is shuffled); lines without two words are never dropped, as a single word is often repeated by chance.

The host is a column: ``url_host`` takes it from a URL; where documents have no URL, their source stands for it.

Each page adds each distinct line once, so that (host, line) pairs are counted by plain partial sums. A
host has at most ``mean distinct lines of a page / ratio`` boilerplate lines; the table of these is stored,
and broadcast only if that is small, else joined by (host, salt), so that a hot host is dealt out. A page's lines meet
the host's lines as a set of hashes, once a page; only pages with a hit compare line by line.

Defined results: a null text stays null and has no lines; the empty text has one empty line; a null
host is a host of its own; texts of any length are split whole; repeated rows count as pages of their own; all columns are kept as they are
but ``text``. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm._common import stored, table

RATIO = 0.01
Z = 3.0
LEAST = 3
SALTS = 64
TWO_WORDS = r"[^\x20\x09][\x20\x09]+[^\x20\x09]"


def url_host(url: Column) -> Column:
    """The lower-cased host of a URL, without user and port; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def lower_bound(n: Column, of: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval for the frequency n / of."""
    n, of = n.cast("double"), of.cast("double")
    p = n / of
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def boilerplate(pages: DataFrame, ratio: float = RATIO, z: float = Z, least: int = LEAST, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, lines, firsts): the hashes of the boilerplate lines of each host that has any, and the first halves of these."""
    per_host = pages.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_host"))
    lines = F.array_distinct(F.filter(_split(F.col(text_col)), lambda x: x.rlike(TWO_WORDS)))
    each = pages.select(F.col(host_col).alias("host"), F.explode(lines).alias("line")).select("host", _key(F.col("line")).alias("key"))
    counted = each.groupBy("host", "key.a", "key.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    joined = counted.withColumnRenamed("host", "h").join(per_host, F.col("h").eqNullSafe(F.col("host")))
    often = joined.where(lower_bound(F.col("n"), F.col("n_host"), z) > ratio)
    return often.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines"), F.collect_set("a").alias("firsts"))


def drop_lines(pages: DataFrame, host_lines: DataFrame, host_col: str = "source", text_col: str = "text", most_rows: int = 100_000) -> DataFrame:
    """Columns row (the page with the boilerplate gone), n_lines, n_dropped."""
    rows = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("row"), F.col(host_col).alias("page_host"), _split(F.col(text_col)).alias("all_lines"))
    same = F.col("page_host").eqNullSafe(F.col("host"))
    if host_lines.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"] <= most_rows:
        joined = rows.join(F.broadcast(host_lines), same, "left")
    else:
        dealt = host_lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(dealt, same & (F.col("own") == F.col("salt")), "left")
    own = joined.withColumn("hits", F.array_intersect(F.transform("all_lines", lambda x: F.xxhash64(x)), F.col("firsts")))
    own = own.withColumn("own_lines", F.when(F.size("hits") > 0, F.filter("lines", lambda x: F.array_contains(F.col("hits"), x["a"]))))
    joined = own.withColumn("lines", F.col("own_lines"))
    kept = F.when(F.col("lines").isNull(), F.col("all_lines")).otherwise(F.filter("all_lines", lambda x: ~F.array_contains(F.col("lines"), _key(x)) | ~x.rlike(TWO_WORDS)))
    out = joined.select("row", "all_lines", kept.alias("kept"))
    text = F.array_join("kept", "\n")
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in pages.columns]
    n = F.coalesce(F.size("all_lines"), F.lit(0))
    return out.select(
        F.struct(*columns).alias("row"),
        F.when(F.col("all_lines").isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"),
        F.when(F.col("all_lines").isNull(), 0).otherwise(n - F.size("kept")).cast("bigint").alias("n_dropped"),
    )


def line_dedup(pages: DataFrame, ratio: float = RATIO, z: float = Z, least: int = LEAST, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Columns row (all columns, text without boilerplate lines), n_lines, n_dropped; one row per page."""
    found = stored(boilerplate(pages, ratio, z, least, host_col, text_col), "boilerplate")
    return drop_lines(pages, found, host_col, text_col)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped", F.length("row.text").cast("bigint").alias("n_chars"), F.sha2(F.col("row.text").cast("binary"), 256).alias("text_sha256"))


OP4_SQL = f"""
WITH l AS (SELECT rowid AS r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
p AS (SELECT source, count(*) AS n_host FROM documents GROUP BY source),
c AS (SELECT source, line, count(DISTINCT r)::DOUBLE AS n FROM l WHERE regexp_matches(line, '{TWO_WORDS}') GROUP BY source, line),
f AS (SELECT c.source, line, n / n_host AS p, n_host::DOUBLE AS m FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, line FROM f WHERE p * m >= {LEAST} - 0.5 AND (p + {Z * Z}::DOUBLE / (2 * m) - {Z}::DOUBLE * sqrt(p * (1 - p) / m + {Z * Z}::DOUBLE / (4 * m * m))) / (1 + {Z * Z}::DOUBLE / m) > {RATIO}::DOUBLE),
m AS (SELECT l.r, l.k, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text FROM m GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, length(t.text)::BIGINT AS n_chars, sha256(t.text) AS text_sha256
FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d LEFT JOIN t ON d.rowid = t.r
"""
