import re

import corpus_pipeline
from test_decontaminate import words
from test_line_dedup import brute as brute_lines
from test_near_dup import brute as brute_near

from kmerloom.llm import toxicity


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [tuple(r) for r in toxicity.grade_toxicity(docs, model).where("not toxic").select("row.doc_id", "row.text", "row.source").collect()]
    lined = {i: t for i, t, _, _ in brute_lines(clean)}
    source = {i: s for i, _, s in clean}
    near = [i for i, _, _, kept in brute_near(sorted(lined.items()), 5) if kept]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        m = min(10, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1 if m else 0)}
    left = [i for i in near if not any(tuple(words(lined[i])[k : k + 10]) in windows for k in range(len(words(lined[i]))))]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(left)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", lined[i] or "")) for i in left)
    assert abs(sum(r.taken for r in got.values()) - 1.5 * total) <= 0.02 * total
    assert all(r.text == lined[i] and r.source == source[i] and r.n_chars == len(r.text) for i, r in got.items())


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for docs in (odd, empty):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns[: len(docs.columns)] == docs.columns
            if name in ("line_dedup", "mixing"):
                assert out.count() == n
            elif name != "mixing":
                assert n == 0 or out.count() >= n - 8


def test_scratch_removes_what_was_made_in_it(spark):
    from pathlib import Path

    from kmerloom.llm import _common

    outside = _common.stored(spark.range(5).toDF("id"), "outside")
    with _common.scratch(spark):
        inside = _common.stored(spark.range(7).toDF("id"), "inside")
        table = _common.kept(spark.range(9).toDF("id"))
        assert inside.count() == 7 and table.count() == 9 and table.is_cached
    assert not table.is_cached and outside.count() == 5
    assert not list(Path(_common.shared_dir(spark).removeprefix("file:")).glob("inside-*"))
