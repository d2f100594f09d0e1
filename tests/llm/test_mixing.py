import random

import duckdb
from pyspark.sql import functions as F

from kmerloom.llm import mixing


def test_equals_sql_and_hits_targets(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "source").distinct()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.OP9_SQL).fetchall()
    got = mixing.op9_mix(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert all(r.taken <= 2 * r.size for r in got)
    again = mixing.op9_mix(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in again]), key=repr)


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 890)], "source string, size bigint")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    # 3000 words by 3, 1, 2, 3: a and c reach their limits of 200 and 20; b and null share 2780 by 1 and 3, null stops at 1780
    assert got == {"a": (100, 200.0), "c": (10, 20.0), None: (890, 1780.0), "b": (1000, 1000.0)}


def test_taken_is_near_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).select("row.source", "size", "source_size", "target", "taken").toPandas()
    by = rows.groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((by.taken - by.target).abs() <= 0.01 * by.target + 1).all()


def test_columns_repeats_and_empty(odd, empty):
    out = mixing.mix(odd)
    assert out.select("row.*").columns == odd.columns and out.count() == odd.count()
    assert mixing.mix(empty).count() == 0


def test_a_very_long_document_leaves_no_gap(spark):
    """40 sources, each with a document as long as a third or all of the others together: targets are met all the same."""
    r = random.Random(5)
    rows = []
    for s in range(40):
        rows += [(s * 10_000 + k, "w " * r.randint(50, 600), f"s{s:02}") for k in range(1000)]
        rows.append((s * 10_000 + 5132, "w " * (100_000 if s % 2 else 300_000), f"s{s:02}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    out = mixing.mix(docs, share=1.2, weights=(1, 1, 1)).select("row.source", "size", "target", "taken").toPandas()
    by = out.groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by.taken - by.target).abs() <= 0.002 * by.target).all()
    assert ((out.taken == out["size"]) | (out.taken == 2 * out["size"]) | (out.taken == 0)).all()


def test_inclusion_follows_the_probabilities(spark):
    """2,000 sources of the same 40 sizes, each a draw of its own: a document enters as often as its size demands."""
    sizes = [96 + k % 8 for k in range(24)] + [500 + k for k in range(16)]
    rows = [(f"s{s}", s * 100 + k, n) for s in range(2000) for k, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "source string, doc_id bigint, size bigint")
    docs = frame.select(F.col("source"), F.concat(F.lit("s"), "source").alias("source_key"), "doc_id", "size", mixing.size_class("size").alias("class"), mixing.uniform(F.col("doc_id").cast("string")).alias("u"), F.col("doc_id").alias("tie")).cache()
    short = docs.select("source_key").distinct().withColumn("short", F.lit(sum(sizes) * 2 // 5).cast("bigint"))
    cuts = mixing.sample(docs, short, "t")
    got = mixing.entered(docs, cuts, "inside").withColumn("k", F.col("doc_id") % 100).groupBy("k").agg(F.avg(F.col("inside").cast("double")).alias("share"), F.first("size").alias("size"), F.first("class").alias("class")).toPandas()
    plan = cuts.groupBy("class").agg(F.avg("take").alias("take"), F.first("words").alias("words"), F.first("n").alias("n")).toPandas().set_index("class")
    for r in got.itertuples():
        want = plan["take"][r[4]] * r.size / plan["words"][r[4]]
        assert abs(r.share - want) < 0.045, (r, want)  # four standard deviations
    # fixed size: exactly ``take`` documents of each class, in every source
    n_in = mixing.entered(docs, cuts, "inside").groupBy("source_key", "class").agg(F.sum(F.col("inside").cast("bigint")).alias("n_in"))
    assert n_in.join(cuts, ["source_key", "class"]).where("n_in <> take").count() == 0
    # unequal: longer documents of a class enter more often
    first = got[got["class"] == got["class"].min()]
    assert first[first["size"] >= 100].share.mean() > first[first["size"] < 100].share.mean()


def test_inclusion_is_in_the_ratio_of_sizes_over_a_source(spark):
    """Sizes of 10, 100 and 1,000 words in one source enter in the ratio 1 : 10 : 100, and the sample has the words asked for."""
    kinds = ((10, 60_000), (100, 6_000), (1_000, 600))
    rows = [(10_000_000 * k + i, size) for k, (size, n) in enumerate(kinds) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, size bigint")
    docs = frame.select(F.lit("s").alias("source"), F.lit("ss").alias("source_key"), "doc_id", "size", mixing.size_class("size").alias("class"), mixing.uniform(F.col("doc_id").cast("string")).alias("u"), F.col("doc_id").alias("tie")).cache()
    rate = 0.0005  # p = 0.005, 0.05, 0.5
    words = sum(n * size * size for size, n in kinds) * rate
    cuts = mixing.sample(docs, spark.createDataFrame([("ss", int(words))], "source_key string, short bigint"), "t")
    got = {r.size: (r.n, r.share) for r in mixing.entered(docs, cuts, "inside").groupBy("size").agg(F.sum(F.col("inside").cast("bigint")).alias("n"), F.avg(F.col("inside").cast("double")).alias("share")).collect()}
    for size, n in kinds:
        assert abs(got[size][0] - n * rate * size) <= 2, got  # places are fixed, rounded
    assert abs(sum(size * n for size, (n, _) in got.items()) - words) <= 10


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x")] * 3 + [(None, "d e", "x"), (None, "f g", "x"), (2, None, None), (3, "", None)] + [(10 + k, "w " * (5 + k), "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = [tuple(r) for r in mixing.mix(docs).select("row.doc_id", "size", "taken").collect()]
    assert len(out) == len(rows) and len({x for x in out if x[0] == 1}) == 1
    assert sorted(x for x in out if x[0] in (2, 3)) == [(2, 0, 0), (3, 0, 0)]
    again = [tuple(r) for r in mixing.mix(docs.repartition(3)).select("row.doc_id", "size", "taken").collect()]
    assert sorted(out, key=repr) == sorted(again, key=repr)
