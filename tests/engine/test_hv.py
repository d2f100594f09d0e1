import numpy as np

from kmerloom.functions import hv


def test_generator_matches_the_standard():
    draw = hv.Mt19937_64()
    assert [draw() for _ in range(10_000)][-1] == 9981545732273789042


def test_base_vectors():
    first = {b: int(v[0]) for b, v in hv.bases().items()}
    last = {b: int(v[-1]) for b, v in hv.bases().items()}
    assert first == {"A": 0x28E837C5CB41DC3E, "C": 0x2245BD5FBB686F68, "T": 0xE75297ED09818A4C, "G": 0x8F0B49B38C72FBAB}
    assert last == {"A": 0x0C11, "C": 0xC4F4, "T": 0x0287, "G": 0x25D6}
    assert len(hv.ones_hv()) == 157 and int(hv.lanes(hv.ones_hv()[None]).sum()) == 10_000


def test_shift_fills_with_zeros():
    bits = hv.lanes(hv.bases()["A"][None])[0]
    for k in (1, 4, 40):
        assert np.array_equal(hv.lanes(hv.shift_right(hv.bases()["A"], k)[None])[0], np.concatenate([bits[k:], np.zeros(k, np.uint8)]))


def test_gram():
    g = hv.gram()
    names = hv.canonical_kmers()
    assert len(names) == 512 and names.index("ACGTA") == 103 and names.index("CCCCC") == 285
    assert np.all(np.diag(g) == 10_000) and g.sum() == 4_815_680 and np.abs(g).sum() == 26_229_744
    assert g[0, :4].tolist() == [10_000, -60, -172, 66]
    off = g[~np.eye(512, dtype=bool)]
    assert off.min() == -362 and off.max() == 374
    assert len(np.unique(hv.kmer_hvs(), axis=0)) == 512


def test_bind_columns(spark):
    from pyspark.sql import functions as F

    a, c = (hv.bases()[b] for b in "AC")
    row = spark.createDataFrame([(a.view(np.int64).tolist(), c.view(np.int64).tolist())], "a array<bigint>, c array<bigint>")
    for k in (0, 3):
        got = row.select(hv.bind_columns(F.col("a"), F.col("c"), k).alias("x")).first().x
        assert got == hv.bind(a, c, k).view(np.int64).tolist()


def test_dimension(spark):
    d = hv.kmer_dimension(spark)
    assert d.count() == 1024 and d.select("kmer_id").distinct().count() == 512
    assert d.where("kmer = 'TTTTT'").first().canon == "AAAAA"
