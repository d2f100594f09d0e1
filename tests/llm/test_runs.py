import math
import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from kmerloom.llm import runs as R


def brute(codes, least=24, power=3):
    """(start, length, period) of all runs, by trying each period."""
    out, n = set(), len(codes)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if codes[i] != codes[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, power * q) and not any(all(codes[k] == codes[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    """The row of one document, in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else math.floor(Fraction(1000 * best[1], best[2]))
    return (doc_id, len(found), *best, milli, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_on_random_words(seed):
    r = random.Random(seed)
    for _ in range(150):
        n, k = r.randint(0, 90), r.choice([1, 2, 2, 3, 5])
        codes = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = 1 + (n - a) // (3 + r.randrange(8))
            codes = [codes[i if i < a else a + (i - a) % p] for i in range(n)]
        least, power = r.choice([(24, 3), (24, 3), (4, 2), (6, 3)])
        want = brute(codes, least, power)
        assert [tuple(x) for x in R.all_runs(np.array(codes, np.int64), least, power).tolist()] == want
        assert not want or R.may_have_runs(np.array(codes, np.int64), least, power)


def test_range_minimum_equals_plain_minimum():
    r = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 300):
        values = r.integers(0, 50, n)
        lo = r.integers(0, n, 400)
        hi = np.minimum(lo + r.integers(0, n, 400), n - 1)
        assert R.RangeMinimum(values)(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]


def test_query_equals_plain_rows(spark, odd, tmp_path):
    cycle = " ".join(f"w{k}" for k in range(7))
    more = [(700, " ".join([cycle] * 5), "a"), (701, "a " * 23, "a"), (702, "a b\x1cc " * 30, "b"), (703, "x y " * 12 + "z " + "x y " * 13, "b"), (704, "a " * 24, "a")]
    rows = [(r.doc_id, r.text, "clash", 1) for r in odd.select("doc_id", "text").collect()]
    rows += [(i, t, "clash", 1) for i, t, _ in more] + [(i, " ".join(f"u{k % 97}" for k in range(150)), "clash", 1) for i in range(800, 860)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string, best long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, R.op13_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain(i, t) for i, t, *_ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 8 and any(r[1] > 1 for r in got)


def test_long_texts_and_empty_tables(spark, empty):
    long = " ".join(str(k % 5000) for k in range(200_000))
    row = R.find_runs(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), id_col="doc_id").first()
    assert [tuple(x) for x in row.runs] == [(0, 200_000, 5000)] and row.collapsed == " ".join(map(str, range(5000)))
    assert R.find_runs(empty).count() == 0
