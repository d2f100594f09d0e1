import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna, hv
from kmerloom.operators import align, encode, identify, similarity
from kmerloom.sources import commits, fasta


def random_dna(seed, n, letters="ACGT"):
    return "".join(random.Random(seed).choices(letters, k=n))


def test_appends_count_once_and_go_on(spark, tmp_path):
    path = f"{tmp_path}/lib"
    rows = lambda *xs: spark.createDataFrame(xs, "category string, sequence string, ord int")
    fasta.write_library(spark.createDataFrame([("a", "x", "AC")], "category string, seq_id string, sequence string"), path)
    assert commits.append(rows(("a", "GG", 2), ("a", "TT", 1), ("b", "CC", 1)), path, "one")
    assert not commits.append(rows(("a", "GG", 2)), path, "one")
    # a call that ended before its record: staged rows that nobody sees, written over by the next call
    (tmp_path / "lib/_commits/000000000-one").rename(tmp_path / "kept")
    assert commits.read_library(spark, path).count() == 1 and spark.read.parquet(path).count() == 1
    assert commits.append(rows(("a", "GG", 2), ("a", "TT", 1), ("b", "CC", 1)), path, "one")
    assert commits.append(rows(("a", "AA", 1)), path, "two") and commits.committed(spark, path) == ["one", "two"]
    got = {(r.category, r.seq_id, r.sequence) for r in commits.read_library(spark, path).collect()}
    assert got == {("a", "x", "AC"), ("a", "a_appended_2", "TT"), ("a", "a_appended_3", "GG"), ("b", "b_appended_1", "CC"), ("a", "a_appended_4", "AA")}
    fresh = f"{tmp_path}/fresh"
    assert commits.append(rows(("c", "A", 1)), fresh, "x") and commits.read_library(spark, fresh).first().seq_id == "c_appended_1"
    with pytest.raises(ValueError):
        commits.append(rows(), path, "a/b")


def test_output_sets_appear_together(spark, tmp_path):
    reads = spark.createDataFrame([("r1", "ACG", "III", "k__B", "t", 5, 3)], "read_id string, sequence string, quality string, taxonomy string, template_id string, orig_len int, final_len int")
    (tmp_path / "set._staged/reads.fastq").mkdir(parents=True)  # left by a run that was stopped
    assert not (tmp_path / "set").exists()
    assert commits.write_reads(reads, f"{tmp_path}/set") and not commits.write_reads(reads, f"{tmp_path}/set")
    assert fasta.read_fastq(spark, f"{tmp_path}/set/reads.fastq").count() == fasta.read_fasta(spark, f"{tmp_path}/set/reads.fasta").count() == 1
    assert not (tmp_path / "set._staged").exists()


def test_encodings_are_kept_over_runs(spark, tmp_path):
    df = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "i int, sequence string")
    path = f"{tmp_path}/store"
    one = df("ACGTACGTA", "ACGTACGTA", None, "", "GGGGGGGN")
    rows, n = encode.encode_through(one, path, buckets=4)
    want = {(r.i, tuple(r.ids), r.norm2) for r in encode.encode_sequences(one).collect()}
    assert n == 3 and {(r.i, tuple(r.ids), r.norm2) for r in rows.collect()} == want
    rows, n = encode.encode_through(one.union(df("TTTTTTT")), path, buckets=4)
    assert n == 1 and rows.count() == 6
    spark.sql(f"DROP TABLE {next(t.name for t in spark.catalog.listTables() if t.name.startswith('encoded_'))}")  # as a new session: the files stay
    rows, n = encode.encode_through(one, path, buckets=4)
    assert n == 0 and {(r.i, tuple(r.ids), r.norm2) for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_packed_sequences(spark):
    texts = ["", None, "A", "ACGT" * 4, "ACGT" * 4 + "T", "NNNN", random_dna(1, 100, "ACGTN."), random_dna(2, 333), "é" + random_dna(3, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", dna.pack(F.col("s")).alias("p"))
    for k in (1, 5, 11, 16):
        for r in df.select("i", F.col("p.n").alias("n"), dna.unpack(F.col("p")).alias("back"), dna.packed_kmers(F.col("p"), k).alias("codes")).collect():
            s = texts[r.i] or ""
            assert r.n == len(s) and r.back == "".join(c if c in "ACGT" else "N" for c in s)
            want = [sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(s[i : i + k])) if set(s[i : i + k]) <= set("ACGT") else -1 for i in range(len(s) - k + 1)]
            assert r.codes == want
    with pytest.raises(ValueError):
        dna.packed_kmers(F.col("p"), 17)


def test_lanes_of_a_column(spark):
    row = hv.kmer_dimension(spark).where("kmer = 'ACGTA'").select(hv.lanes_column(F.col("hv")).alias("x"), "hv").first()
    assert row.x == hv.lanes(np.array(row.hv, np.int64)[None])[0].tolist()


@pytest.mark.parametrize("normalize", [True, False])
def test_bounded_best_windows_equal_all_windows(spark, normalize, monkeypatch):
    monkeypatch.setattr(similarity, "PASS", 6)
    monkeypatch.setattr(similarity, "GROUP_QUERIES", 3)
    monkeypatch.setattr(similarity, "STRIP_KMERS", 500)
    base = random_dna(5, 400)
    refs = [("long", base + random_dna(6, 300)), ("odd", random_dna(7, 30) + base[:135] + "N" * 30 + random_dna(8, 77)), ("short", random_dna(9, 60)), ("tiny", "AC"), ("unknown", "N" * 200), ("empty", ""), ("edge", random_dna(10, 125)), ("edge+", random_dna(10, 126)), ("repeat", "ACGTTGCA" * 50)]
    asked = [(0, base[130:255]), (1, base[40:165]), (2, random_dna(11, 90)), (3, "NN"), (4, "ACGTTGCA" * 15), (5, base), (6, random_dna(7, 30) + base[:95])]
    r = spark.createDataFrame(refs, "ref_id string, sequence string")
    q = encode.encode_sequences(spark.createDataFrame(asked, "query_id int, sequence string")).select("query_id", F.col("ids").alias("query_ids"))
    windows = encode.encode_windows(r.withColumn("whole", F.length("sequence") <= 125)).select("ref_id", "window_start", "ids", "whole")
    want = {(x.query_id, x.ref_id): (x.score, x.pos) for x in similarity.best_window(q.crossJoin(windows), normalize).collect()}
    found = similarity.best_windows(q, r, normalize).collect()
    assert {(x.query_id, x.ref_id): (x.score, x.pos) for x in found} == want
    long = [x for x in found if x.n_windows > 20]
    assert sum(x.n_scored for x in long) < 0.9 * sum(x.n_windows for x in long)


def test_alignment_of_long_texts_in_little_memory():
    import tracemalloc

    query = random_dna(1, 3000)
    reference = random_dna(2, 2500) + query[:1000] + "ACG" + query[1200:] + random_dna(3, 2500)
    tracemalloc.start()
    found = align.align(reference, query)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20  # all bits of the way back would be 6 MB, all costs 84 MB
    assert found["min_errors"] <= 203 and found["aligned_query"].replace("-", "") == query and found["aligned_reference"].replace("-", "") == reference[found["start"] : found["end"]]


def test_short_numbers(spark):
    values = [0.0, 1.0, -1.0, 0.75, 0.12345651, 0.0001234, 0.00001234, -0.5, 123456.7, 1234567.0, 1e-9, 100000.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(identify.short_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{v:g}" for v in values]
