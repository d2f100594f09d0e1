import math
import random
import re

import numpy as np
from conftest import prose

from kmerloom.llm import toxicity


def test_ordinal_fit_recovers_order():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 3))
    z = x @ [2.0, -1.0, 0.0] + r.logistic(size=3000)
    grade = (z > -0.5).astype(int) + (z > 1.5)
    w, t = toxicity.fit_ordinal(x, grade)
    assert abs(w[0] - 2) < 0.35 and abs(w[1] + 1) < 0.3 and abs(w[2]) < 0.2
    assert t[0] < t[1] and abs(t[0] + 0.5) < 0.3 and abs(t[1] - 1.5) < 0.3


def test_gradient_is_right():
    r = np.random.default_rng(6)
    x, grade = r.normal(size=(50, 2)), r.integers(0, 3, 50)

    def loss(w, t):
        p = np.column_stack([np.ones(50), 1 / (1 + np.exp(-((x @ w)[:, None] - t))), np.zeros(50)])
        return -np.log(p[np.arange(50), grade] - p[np.arange(50), grade + 1]).mean()

    w, t = toxicity.fit_ordinal(x, grade, penalty=0.0, steps=3000, rate=0.02)
    best = loss(w, t)
    for k in range(2):
        for e in (0.05, -0.05):
            assert loss(w + e * np.eye(2)[k], t) >= best - 1e-6 and loss(w, t + e * np.eye(2)[k]) >= best - 1e-6


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    asked = docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    truth = toxicity.grade_toxicity(asked, model).select("toxic", "row.label").toPandas()
    assert len(truth) > 100 and (truth.toxic == (truth.label == 1)).mean() > 0.95
    assert not truth.toxic[truth.label == 0].mean() > 0.01


def test_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(100, 130)] + [(None, 1, 0), (7, 0, None), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.grade_toxicity(odd, model)
    assert got.select("row.*").columns == odd.columns and got.count() == odd.count()
    assert got.where("p_toxic < 0 or p_toxic > 1 or expected_severity > 2").count() == 0
    assert toxicity.grade_toxicity(empty, toxicity.train(empty, labels)).count() == 0


def test_severity_follows_graded_labels(spark):
    """Labels of three values: mild words make grade 1, harsh ones grade 2, and the expected severity tells them apart."""
    r = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        grade = k % 3
        words = prose(5000 + k, 60, 2000).split()
        for _ in range(3):
            if grade:
                words.insert(r.randrange(len(words)), "mildword" if grade == 1 else r.choice(["mildword", "harshword", "harshword"]))
        rows.append((k, " ".join(words)))
        labels.append((k, grade * 5))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = toxicity.grade_toxicity(docs, model).select("row.doc_id", "expected_severity", "grade").toPandas()
    by = out.groupby(out.doc_id % 3).expected_severity.mean()
    assert by[0] < 0.2 < 0.8 < by[1] < by[2] and ((out.doc_id % 3) == out.grade).mean() > 0.85


def test_scores_equal_the_plain_form(spark, odd):
    """Probabilities, severity and grades from plain word counts."""
    words = ["abc", "x", "the"]
    key = lambda w: int(toxicity.word_counts(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0])
    weight = dict(zip(words, (0.7, -0.4, 1.1)))
    order = sorted(words, key=key)
    model = toxicity.OrdinalModel(np.array([key(w) for w in order], np.uint64), np.array([weight[w] for w in order]), np.array([0.3, 1.2]))
    docs = odd.union(spark.createDataFrame([(900, "ABC abc, x; the THE the é-abc", *[None] * (len(odd.columns) - 2))], odd.schema))
    for r in toxicity.grade_toxicity(docs, model).collect():
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.row.text or "").translate({k: k + 32 for k in range(65, 91)}))
        score = sum(weight[w] * math.log1p(found.count(w)) for w in words)
        p = [1 / (1 + math.exp(-(score - t))) for t in (0.3, 1.2)]
        assert math.isclose(r.p_toxic, p[0], rel_tol=1e-9) and math.isclose(r.expected_severity, sum(p), rel_tol=1e-9)
        exact = [1 - p[0], p[0] - p[1], p[1]]
        assert r.grade == exact.index(max(exact)) and r.toxic == (p[0] >= 0.5)


def test_copies_count_once():
    keys = np.array([[1, 2], [1, 5], [9, 5], [0, 0], [0, 0], [1, 2]], np.int64)
    assert toxicity.one_of_copies(keys, np.array([0, 0, 0, 0, 0, 1])).tolist() == [True, False, False, True, True, True]
