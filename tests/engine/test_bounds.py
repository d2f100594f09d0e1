"""Work and memory that do not grow with a batch or a table."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import encode, similarity
from kmerloom.plans import catalog

TEXTS = ["", "A", "ACGT" * 4, "ACGTN" * 13, "." * 40, "ACGGT" * 3 + ".", None, "ÄCGT𝄞" * 7, "T" * 33]


def texts(n, seed=1):
    r = random.Random(seed)
    return TEXTS + ["".join(r.choices("ACGT.", [9, 9, 9, 9, 1], k=r.randrange(200))) for _ in range(n)]


def test_encoders_hand_on_small_batches(spark):
    batch = pa.record_batch({"s": pa.array(["ACGT" * 100_000] * 20 + ["A"] * 1000 + [None])})
    parts = list(encode.small_parts(batch, "s"))
    assert sum(map(len, parts)) == len(batch) and max(map(len, parts)) <= encode.PART_ROWS
    assert max(sum(len(x or "") for x in p.column("s").to_pylist()) for p in parts) <= encode.PART_SIZE
    long = pa.record_batch({"s": pa.array(["A" * (2 * encode.PART_SIZE), "C"])})
    assert [len(p) for p in encode.small_parts(long, "s")] == [1, 1]
    rows = spark.createDataFrame(list(enumerate(texts(600))), "i int, sequence string").coalesce(1)
    sizes = encode.encode_sequences(rows).mapInArrow(lambda bs: (pa.record_batch({"n": [len(b)]}) for b in bs), "n bigint")
    assert sum(r.n for r in sizes.collect()) == len(texts(600))
    counted = encode.count_vectors(rows).select("i", "counts", "norm2")
    again = encode.count_vectors(encode.encode_sequences(rows)).select("i", "counts", "norm2")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, again.collect()))


def test_queries_hand_python_lean_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    catalog.documents_dna(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_packing_by_batches_equals_the_built_in_functions(spark):
    df = spark.createDataFrame(list(enumerate(texts(60))), "i int, sequence string")
    native = df.select("i", dna.pack(F.col("sequence")).alias("p"))
    want = native.select("i", "p.n", "p.words", "p.unknown", dna.unpack(F.col("p"), ".").alias("back"))
    packed = encode.pack_sequences(df)
    got = encode.unpack_sequences(packed, ".").select("i", "n", "words", "unknown", "sequence")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for k in (1, 5, 11, 16):
        codes = {r.i: [c for c in r.c if c >= 0] for r in native.select("i", dna.packed_kmers(F.col("p"), k).alias("c")).collect()}
        found = {r.i: (r.n, r.total, r.most, r.n_distinct) for r in encode.packed_kmer_sums(packed, "i", k).collect()}
        assert found == {i: (len(c), sum(c), max(c), len(set(c))) for i, c in codes.items() if c}


def test_broadcast_queries_meet_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_SCORES", 30)
    rows = spark.createDataFrame(list(enumerate(texts(50))), "id int, sequence string").coalesce(1)
    asked = rows.where("id % 10 = 0").withColumnRenamed("id", "q")
    one = similarity.score_queries(asked, rows, "q", "id")
    grid = similarity.score_queries(asked, rows, "q", "id", most_broadcast=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, grid.collect()))
    most = similarity.met_by_broadcast(asked.select("q"), rows.select("id", F.array("id").alias("ids")), lambda a, b: pa.table({"n": [a.num_rows * b.num_rows]}), "n bigint", 30)
    sizes = [r.n for r in most.collect()]
    assert max(sizes) <= 30 and sum(sizes) == asked.count() * rows.count()


def test_single_precision_vectors_travel_as_they_are(spark):
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(70, 8)), 3).astype(np.float32)
    v[7], v[9] = 0, v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    found = similarity.cosine_argmax(df, df, cell_bytes=1000, tile=5)
    wide = similarity.cosine_argmax(*[df.withColumn("embedding", F.col("embedding").cast("array<double>"))] * 2, cell_bytes=1000, tile=5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wide.collect())) and found.count() == 69
    assert "array<double>" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert similarity.CELL_BYTES <= 16 << 20


def test_counts_of_single_keys_are_not_aggregated(spark):
    df = spark.createDataFrame([(i if i > 2 else None, s) for i, s in enumerate(texts(40))], "i int, sequence string")
    once = df.where("i is not null")
    rows = lambda x: sorted(map(tuple, x.collect()), key=str)
    found = encode.kmer_counts(once, "i")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString() and rows(found) == rows(encode.kmer_counts_native(once, "i"))
    for repeated in (df, df.union(df.where("i < 20")), df.limit(0)):
        assert rows(encode.kmer_counts(repeated, "i")) == rows(encode.kmer_counts_native(repeated, "i"))


def test_products_of_panes_are_sums_of_rows(monkeypatch):
    """Windows' products, whatever the number of panes that are added up at once."""
    from kmerloom.functions import hv
    from kmerloom.operators import identify

    r = np.random.default_rng(2)
    v = r.poisson(0.4, (5, 512)).astype(float) @ hv.gram()
    shapes = [(40, 515), (1, 3), (1, 125), (1, 60), (3, 145), (1, 124)]
    pieces = [{"k": k % 2, "piece": "".join(r.choice(list("ACGT."), size)), "n_windows": n, "stale": "ACGTA"} for k, (n, size) in enumerate(shapes)]
    made = pa.array(pieces, pa.struct([("k", pa.int32()), ("piece", pa.string()), ("n_windows", pa.int32()), ("stale", pa.string())]))
    for mode in ("direct", "incremental"):
        want = v @ identify._window_matrix(made, mode).T
        for panes in (1, 7, 256):
            monkeypatch.setattr(identify, "PANES", panes)
            assert (identify._products(v, made, mode) == want).all()
