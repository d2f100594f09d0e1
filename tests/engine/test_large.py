import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import hv
from kmerloom.operators import propagate, taxonomy
from kmerloom.operators.similarity import normalized
from kmerloom.session import numbered


def rows_of(df):
    return sorted(map(tuple, df.select("parent", "place", "seq_no", "best_score", "added").collect()))


@pytest.fixture(scope="module")
def hot(spark):
    """Two phyla, one with most sequences, many of them near copies of one another."""
    r = random.Random(4)
    bases = ["".join(r.choices("ACGT", k=200)) for _ in range(40)]
    library, lineages = [], []
    for k in range(420):
        s = list(bases[k % 40] if k % 3 else "".join(r.choices("ACGT", k=150)))
        s[k % len(s)] = "ACGT"[k % 4]
        node = "s__hot" if k % 7 else f"s__few{k % 2}"
        library.append((node if k % 11 else "p__A", f"q{k:04d}", "".join(s)))
    for s, way in (("s__hot", "p__A"), ("s__few0", "p__A"), ("s__few1", "p__B")):
        lineages.append((f"k__K; {way}; {s}",))
    return spark.createDataFrame(library, "category string, seq_id string, sequence string"), spark.createDataFrame(lineages, "lineage string")


@pytest.mark.parametrize(("sizes", "most", "normalize"), [((50, 60, 40), 65_536, True), ((0, 100, 64), 0, True), ((50, 200, 1000), 65_536, False)])
def test_rounds_equal_the_walk(spark, hot, sizes, most, normalize, monkeypatch):
    threshold = 0.75 if normalize else 900_000.0
    want = rows_of(propagate.score_descendants(*hot, threshold, normalize))
    monkeypatch.setattr(propagate, "MOST_BROADCAST", most)
    assert rows_of(propagate.score_descendants(*hot, threshold, normalize, *sizes)) == want
    added = sum(r[4] for r in want)
    assert 0 < added < len(want) and {r[0] for r in want} == {"p__A", "p__B"}


def test_each_row_is_stored_for_one_round(spark, hot, monkeypatch):
    """However many rounds there are, the rows are stored once; later rounds read what is held, and the text of what is added comes last."""
    names, counts = [], []

    def kept(df, what, *by, store=propagate.stored):
        out = store(df, what, *by)
        names.append(what), counts.append(out.count())
        return out

    monkeypatch.setattr(propagate, "stored", kept)
    found = propagate.score_descendants(*hot, 0.75, True, 50, 60, 40)
    n = found.count()
    assert names.count("propagate-rows") == 1 and names.count("propagate-settled") > 3
    assert sum(c for w, c in zip(names, counts) if w == "propagate-settled") == counts[names.index("propagate-rows")] >= n


def test_candidates_in_single_precision_lose_no_best_score():
    r = np.random.default_rng(3)
    base = r.poisson(3, (12, 512)).astype(float)
    rows = np.concatenate([base, base * 7, base + (r.random((12, 512)) < 0.002), r.poisson(0.02, (40, 512)), np.zeros((2, 512)), base[:, ::-1] * 300]).astype(float)
    projected = rows @ hv.gram()
    norms = (projected * rows).sum(1)
    want = np.maximum(normalized(projected @ rows[::2].T, norms[:, None], norms[None, ::2]).max(1), 0.0)
    held = propagate._Held(True)
    held.add(rows[::2], norms[::2])
    best = np.zeros(len(rows))
    held.raise_best(best, projected, norms)
    assert np.allclose(best, want, rtol=0, atol=1e-14) and (np.floor(best * 100) == np.floor(want * 100))[want < 1 - 1e-9].all()


def test_rounds_take_an_empty_table(spark):
    empty = spark.createDataFrame([], "parent string, place string, seq_id string, own boolean, seq_no bigint, ids array<smallint>")
    assert propagate.settle_in_rounds(empty, 0.75, True).count() == 0


def test_numbered_within_keys(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.randrange(1000), k) for k in range(3000)] + [(None, 5, 9000), (None, 6, 9001)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(7)
    got = sorted((x.k or "", x.pos, x.o) for x in numbered(df, "k", ["o", "i"], "pos").collect())
    for key in {x[0] for x in got}:
        own = [x for x in got if x[0] == key]
        assert [x[1] for x in own] == list(range(len(own))) and [x[2] for x in own] == sorted(x[2] for x in own)
    every = sorted((x.pos, x.o, x.i) for x in numbered(df, None, ["o", "i"], "pos").collect())
    assert [x[0] for x in every] == list(range(len(rows))) and [x[1:] for x in every] == sorted(x[1:] for x in every)


def test_intervals_of_a_forest_and_ways_of_a_graph(spark):
    forest = spark.createDataFrame([("k__A; p__B; c__D",), ("k__A; p__B; c__C",), ("k__A; p__ B; c__C",), ("k__A; p__E",), ("k__Z",)], "lineage string")
    ways = taxonomy.paths(forest)
    assert not taxonomy.is_forest(ways)  # c__C below p__B and below "p___B"
    tree = forest.where("not contains(lineage, ' B')")
    assert taxonomy.is_forest(taxonomy.paths(tree))
    tour = taxonomy.intervals(taxonomy.paths(tree))
    assert sorted(map(tuple, tour.collect())) == [("c__C", "p__B", 3, 2, 2), ("c__D", "p__B", 3, 3, 3), ("k__A", None, 1, 0, 4), ("k__Z", None, 1, 5, 5), ("p__B", "k__A", 2, 1, 3), ("p__E", "k__A", 2, 4, 4)]
    down = taxonomy.subtrees(tour.where("node = 'k__A'"), tour).orderBy("first")
    assert [r.descendant for r in down.collect()] == ["p__B", "c__C", "c__D", "p__E"]
    rows = lambda df: sorted((r.ancestor, r.descendant, tuple(r.path)) for r in df.collect())
    for index in (tree, forest):
        assert rows(taxonomy.descendants_of(index)) == rows(taxonomy.descendants(taxonomy.edges(index)))
    assert taxonomy.descendants_of(tree.limit(0)).count() == 0
    loop = spark.createDataFrame([("p__A; c__B; p__A",)], "lineage string")
    assert not taxonomy.is_forest(taxonomy.paths(loop))
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.descendants_of(loop)
