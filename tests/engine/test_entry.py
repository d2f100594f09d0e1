"""The registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from kmerloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - {"kmer_gram", "doc_hdc_similarity", "doc_window_kmers_sliding"}))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert canonical(map(tuple, got.select(*columns).collect())) == canonical(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_other_queries_have_rows(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert entry.queries()[name](spark, SF).count() > 0, name


def test_simulate_reads_does_the_default_job(spark):
    reads = catalog.QUERIES["simulate_reads"](spark, SF).cache()
    # templates shorter than a read are skipped, so reads may be fewer than asked for
    assert 2000 < reads.count() <= 10_000 and 20 < reads.select("taxonomy").distinct().count() <= 25
