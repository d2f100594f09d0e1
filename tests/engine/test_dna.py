import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import encode


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


def test_revcomp_and_canonical(spark):
    assert one(spark, "ACGTN", dna.revcomp) == "NACGT"
    assert one(spark, "TTTTT", dna.canonical) == "AAAAA" and one(spark, "GGGGG", dna.canonical) == "CCCCC"
    assert one(spark, "AXR", dna.revcomp) == "NNT"


def test_kmers(spark):
    assert one(spark, "ACGTACG", lambda s: dna.kmers(s, 5)) == ["ACGTA", "CGTAC", "GTACG"]
    assert one(spark, "ACG", dna.kmers) == [] and one(spark, "ACGTNACGTA", dna.known_kmers) == ["ACGTA"]
    assert one(spark, "TTTTTC", dna.known_kmers) == ["AAAAA", "GAAAA"]


@pytest.mark.parametrize(("length", "cpu", "gpu"), [(0, 0, 0), (124, 0, 0), (125, 0, 1), (126, 1, 1), (135, 1, 2), (136, 2, 2), (1480, 136, 136), (1121, 100, 100)])
def test_window_counts(spark, length, cpu, gpu):
    rows = spark.createDataFrame([("A" * length,)], "sequence string")
    assert dna.windows(rows).count() == cpu and dna.windows(rows, rule="gpu").count() == gpu


def test_windows_reject_unknown_rule(spark):
    with pytest.raises(ValueError):
        dna.windows(spark.createDataFrame([("A",)], "sequence string"), rule="x")


def test_names(spark):
    assert one(spark, "s__a/b(c) d", dna.safe_name) == "s__a_bc_d" and one(spark, "s__a/b(c) d", dna.normalize_category) == "s__a/b(c)_d"


def test_nmers(spark):
    got = [r.nmer for r in dna.nmers(spark, 3).orderBy("code").collect()]
    assert got == [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]


def test_kmer_code(spark):
    assert one(spark, "ACGT", dna.kmer_code) == 0b00011011


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", max_size=60))
def test_ids_of_both_strands_agree(s):
    rc = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    a, b = encode.sequence_ids(s.encode()), encode.sequence_ids(rc.encode())
    assert sorted(a.tolist()) == sorted(b.tolist())


def test_native_and_vectorised_counts_agree(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(k, "".join(r.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=n))) for k, n in enumerate([0, 3, 5, 80, 400])], "id bigint, sequence string")
    native = sorted(map(tuple, encode.kmer_counts_native(rows, "id").collect()))
    assert native == sorted(map(tuple, encode.kmer_counts(rows, "id").collect())) and len(native) > 100
