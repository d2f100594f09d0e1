import collections
import math
import re
import zlib

import numpy as np

from kmerloom.llm import quality


def test_forest_learns_and_flattens():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit_forest(x[:3000], y[:3000])
    p = forest.predict(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.95
    # flattened walk equals a walk node by node
    for row in x[3000:3020]:
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while forest.left[t, node] != node:
                node = forest.left[t, node] if row[forest.feature[t, node]] <= forest.threshold[t, node] else forest.right[t, node]
            total += forest.value[t, node]
        assert np.isclose(1 / (1 + np.exp(-total)), forest.predict(row[None])[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "quality").toPandas()
    assert len(scored) > 50 and (scored.predicted == scored.quality).mean() > 0.9


def test_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100, 130)] + [(None, 1, 0), (7, None, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(odd, quality.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty, quality.train(empty, labels)).count() == 0
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score_quality(odd, quality.train(odd, none)).collect()} == {0.5}


def plain_statistics(text):
    """The statistics of one text, byte by byte."""
    data = (text or "").encode()
    names = {**dict.fromkeys(range(32), 11), **dict.fromkeys(range(97, 123), 1), **dict.fromkeys(range(65, 91), 2), **dict.fromkeys(range(48, 58), 3), 32: 4, 9: 4, 10: 5, 13: 5}
    names |= dict.fromkeys(range(192, 256), 6) | dict.fromkeys(range(128, 192), 7) | dict.fromkeys(b".!?", 8) | dict.fromkeys(b",;:-", 9) | dict.fromkeys(b"\'\"()[]{}<>", 10)
    kind = lambda b: names.get(b, 0)
    words, lines = re.findall(rb"[^ \t\n\x0b\x0c\r]+", data), re.findall(rb"[^\n]+", data)
    ratio = lambda a, b: a / b if b else 0.0
    most = lambda xs: max(collections.Counter(xs).values(), default=0)
    n, sizes = len(words), [len(w) for w in words]
    mean = ratio(sum(sizes), n)
    upper, lower = [sum(kind(b) == 2 for b in w) for w in words], [sum(kind(b) == 1 for b in w) for w in words]
    pairs = list(zip(words, words[1:]))
    out = [math.log1p(len(data)), math.log1p(n), math.log1p(len(lines)), mean, math.sqrt(max(0, ratio(sum(s * s for s in sizes), n) - mean**2))]
    out += [ratio(len(set(words)), n), ratio(most(words), n), ratio(len(set(pairs)), len(pairs)), ratio(most(pairs), len(pairs))]
    out += [ratio(sum(x), n) for x in ([u > 1 and v == 0 for u, v in zip(upper, lower)], [kind(w[0]) == 2 and v > 0 for w, v in zip(words, lower)], [kind(w[-1]) == 0 or w[-1] == 33 for w in words], [kind(w[-1]) == 8 for w in words], [len(w) <= 2 and kind(w[-1]) == 0 for w in words])]
    out += [ratio(len(set(lines)), len(lines)), ratio(most(lines), len(lines)), ratio(sum(kind(x[-1]) == 8 for x in lines), len(lines)), ratio(n, len(lines))]
    return out + [ratio(sum(kind(b) == c for b in data), len(data)) for c in range(12)]


def test_statistics_equal_the_plain_form(odd):
    texts = [r.text or "" for r in odd.select("text").collect()] + ["A!! BB!! b. \n\n#$%\nb b b b", "\r\x00 x", "Zz " * 400_000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = np.concatenate([quality.statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in quality.T.runs(offsets)])
    assert len(texts[-1]) > 1 << 20
    np.testing.assert_allclose(got, [plain_statistics(t) for t in texts], rtol=1e-9, atol=1e-9)


def test_repeated_ids_push_no_labelled_row_out(spark):
    rows = [(1, f"copy {k}") for k in range(50)] + [(k, f"text {'!!' * k}") for k in range(2, 12)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)], "doc_id bigint, quality int, toxic int")
    forest = quality.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, max_rows=12, least=0.0)
    n = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(1, 12))
    ones = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(1, 12, 2))
    assert math.isclose(forest.base, math.log(ones / (n - ones)))


def plain_forest(x, y, trees, depth, rate, least=1.0, l2=1.0):
    """Boosted trees grown by trying every bin border of every feature on the rows themselves; returns the scores before the logistic function."""
    borders = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.N_BINS + 1)[1:-1]))) for f in range(x.shape[1])]
    base = math.log(y.mean() / (1 - y.mean()))
    score = [base] * len(x)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def grow(rows, left):
            """Leaves of the tree over some rows."""
            best, at = 1e-6, None
            gain_of = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + l2)
            for f in range(x.shape[1]) if left else ():
                for cut in borders[f]:
                    low, high = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
                    if min(sum(h[i] for i in low), sum(h[i] for i in high)) >= least:
                        gain = gain_of(low) + gain_of(high) - gain_of(rows)
                        if gain > best + 1e-9:
                            best, at = gain, (low, high)
            return [leaf for part in at for leaf in grow(part, left - 1)] if at else [rows]

        for leaf in grow(list(range(len(x))), depth):
            value = -rate * sum(g[i] for i in leaf) / (sum(h[i] for i in leaf) + l2)
            for i in leaf:
                score[i] += value
    return np.array(score)


def test_fit_equals_an_exhaustive_search():
    r = np.random.default_rng(12)
    x = np.round(r.normal(size=(70, 3)), 2)
    y = ((x[:, 0] + 0.3 * r.normal(size=70) > 0) ^ (x[:, 1] > 0.8)).astype(float)
    got = quality.fit_forest(x, y, trees=3, depth=2, rate=0.3).predict(x)
    assert np.allclose(got, 1 / (1 + np.exp(-plain_forest(x, y, 3, 2, 0.3))), atol=1e-9)
