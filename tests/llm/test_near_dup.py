import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from kmerloom.llm import near_dup as nd
from kmerloom.llm.graph import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k][1]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def groups():
    r = random.Random(4)
    rows, n = [], 0
    for g in range(12):
        words = prose(500 + g, 60 + 40 * (g % 3)).split()
        for _ in range([1, 2, 3, 8, 150][g % 5]):
            own = list(words)
            for _ in range(r.randrange(0, 5)):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    r.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (5002, "  "), (5003, "One"), (5004, "oNE"), (5005, "one two")]


@pytest.mark.parametrize(("width", "small"), [(2, 64), (5, 8)])
def test_equals_brute_force(spark, width, small):
    rows = groups()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = nd.near_duplicates(docs, width=width, small_node=small).collect()
    assert sorted(map(tuple, got)) == brute(rows, width)


def test_odd_documents(odd, empty):
    got = nd.near_duplicates(odd, width=2).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == by[5].component_id == 1 and by[1].kept and not by[4].kept
    assert by[2].kept and by[3].kept and by[6].n_shingles == 0 and by[None].kept
    assert nd.near_duplicates(empty).count() == 0
    left = nd.drop_near_duplicates(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in odd.collect()} - {4, 5, 40}


def test_odd_sketch_never_exceeds_the_difference():
    r = np.random.default_rng(9)
    for d in (0, 3, 40, 700):
        x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        y = np.concatenate([x[d:], r.integers(0, 1 << 63, d, dtype=np.uint64)])
        s = nd.odd_sketch(np.concatenate([x, y]), np.array([0, 2000, 4000]))
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= 2 * d


def test_recall_plan():
    trees, branches = nd.plan_trees(1000, 0.8, 0.999999)

    def missed(s):
        alive = 1.0
        for b in reversed(branches):
            alive = 1 - (1 - s * alive) ** b
        return (1 - alive) ** trees

    agree = np.random.default_rng(3).binomial(128, 0.8, 200_000) / 128  # tokens are shared by all trees
    assert np.mean([missed(s) for s in agree]) <= 1e-6
    assert missed(0.8) <= 1e-6
    assert len(nd.plan_trees(10**11, 0.8, 0.999)[1]) > len(branches)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)], "a bigint, b bigint")
    got = dict(map(tuple, components(links).collect()))
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (90, 95, 100)} == {90}


def test_classes_with_equal_halves_of_their_digests(spark, monkeypatch):
    original = nd._profiler

    def clashing(*args):
        profile = original(*args)

        def work(batches):
            for b in profile(batches):
                yield b.set_column(b.schema.get_field_index("d1"), "d1", pa.array([5] * len(b), pa.int64()))

        return work

    monkeypatch.setattr(nd, "_profiler", clashing)
    rows = groups()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, nd.near_duplicates(docs, width=2).collect())) == brute(rows, 2)


def left_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(3)
    return sorted(map(tuple, nd.drop_near_duplicates(docs).select("doc_id", "text").collect()), key=repr)


def test_dropping_judges_by_row(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    assert left_of(spark, [(1, a, "x"), (5, b, "x"), (5, a, "y")]) == [(1, a), (5, b)]  # the only copy of b stays
    assert left_of(spark, [(3, a, "x"), (3, a, "x"), (3, a, "y")]) == [(3, a)]
    near = " ".join([*a.split()[:-1], "zz"])
    assert len(left_of(spark, [(5, a, ""), (5, near, ""), (5, b, "")])) == 2  # one of a and near, and b
    left = left_of(spark, [(None, a, ""), (None, a, ""), (None, c, ""), (7, c, ""), (None, near, "")])
    assert len(left) == 2 and (7, c) in left  # a null id comes after all others
    assert len(left_of(spark, [(1, "", ""), (1, "", ""), (2, None, "")])) == 3


def test_a_text_over_a_chunk(spark):
    """Texts longer than 1 MiB are whole sets: a change at the very end counts."""
    long = prose(77, 250_000, 50_000)
    assert len(long.encode()) > 1 << 20
    other = long + " " + prose(78, 100_000, 50_001)
    rows = [(1, long), (2, long + " tail"), (3, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, nd.near_duplicates(docs, width=2).collect())) == brute(rows, 2)
