"""Odd documents that every operator must take: nulls, empties, a very long text, ties, repeats, clashing columns."""

import random

import pytest

#: Column names that the operators use inside.
CLASHES = ("row", "id", "key", "rid", "host", "lines", "rep", "size", "u", "bin", "target", "taken", "kind", "n", "words", "hits", "score")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    words = ["".join(random.Random(f"{vocabulary}-{k}").choices("abcdefgäßé", k=2 + k % 7)) for k in range(vocabulary)]
    return " ".join(r.choice(words) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def rows_of(texts):
    """Rows (doc_id, text, source) with the other columns filled in."""
    return [(i, t, "en", s, None if t is None else len(t), *["clash"] * len(CLASHES)) for i, t, s in texts]


def odd_texts():
    base = prose(1, 120)
    near = base.replace(base.split()[3], "zz", 1)
    passage = prose(99, 60)
    return [
        (1, base, "a"),
        (2, None, "a"),
        (3, "", None),
        (4, base, "b"),
        (5, near, "b"),
        (6, " \n\t ", "c"),
        (7, "x", "c"),
        (8, prose(2, 4000) + passage + prose(3, 4000), "a"),
        (9, prose(4, 80) + " " + passage, None),
        (10, "mail bob.x@example.com or +1 (437) 555-0689, 10.0.0.255, 4111 1111 1111 1111 é€😀 end", "a"),
        (11, passage, "c"),
        (11, passage, "c"),
        (12, "ab " * 200, "b"),
        (20, prose(5, 30), "a"),
        (None, prose(6, 50), "a"),
        (40, "😀" * 40 + base, "b"),
        (-3, prose(7, 90), "d"),
        *[(100 + k, prose(1000 + k, 30 + k), "abc"[k % 3]) for k in range(30)],
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(odd_texts()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
