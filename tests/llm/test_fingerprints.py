import hashlib
import random
import re

import xxhash
from conftest import prose

from kmerloom.llm import fingerprints as fp


def test_edits_and_neighbours(odd):
    rows = sorted([(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()], key=lambda x: (x[0] is not None, x[0] or 0))
    got = fp.fingerprint_documents(odd).collect()
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == sorted(want, key=repr)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 16
    bits = [int(r.fingerprint, 16) for r in got]
    for r in got:
        if r.doc_id is not None and r.doc_id % 20 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ b).bit_count() <= 3 for b in bits)
        else:
            assert r.n_near is None


def test_search_equals_brute_force(spark):
    r = random.Random(8)
    rows = [r.getrandbits(64) for _ in range(300)]
    rows += [x ^ sum(1 << b for b in r.sample(range(64), k)) for x in rows[:60] for k in (1, 2, 3, 4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in rows]
    df = spark.createDataFrame([(x,) for x in set(signed)], "f bigint")
    for radius in (0, 3, 5):
        got = {(a, b) for a, b in map(tuple, fp.within_radius(df.selectExpr("f as q"), df, radius).collect())}
        want = {(a, b) for a in set(signed) for b in set(signed) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
        assert got == want


def simhash(text):
    """Plain form: pairs of successive words vote with Spark's xxhash64 (seed 42, chained), weighted by the first word's length up to 8."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    votes, weight = [0] * 64, 0
    for k, w in enumerate(words):
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        if k + 1 < len(words):
            h = xxhash.xxh64(words[k + 1].encode(), seed=h).intdigest()
        own = min(len(w), 8)
        weight += own
        for j in range(64):
            votes[j] += own * (h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * votes[j] > weight)


def test_fingerprints_equal_the_plain_form(odd):
    rows = sorted([(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()], key=lambda x: (x[0] is not None, x[0] or 0))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        own, new, following = simhash(t), simhash(t[: len(t) - cut] + after[:cut]), simhash(after)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        want.append((i, f"{own:016x}", f"{new:016x}", like(own, new), like(own, following)))
    got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.fingerprint_documents(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_long_text(spark):
    long = prose(9, 250_000, 5000)
    assert len(long.encode()) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, "b c d")], "doc_id bigint, text string")
    got = {r.doc_id: (r.fingerprint, r.n_chars) for r in fp.fingerprint_documents(docs).collect()}
    assert got == {1: (f"{simhash(long):016x}", len(long)), 2: (f"{simhash('b c d'):016x}", 5)}


def test_more_blocks_lead_among_more_fingerprints(spark):
    assert fp.leading_blocks(10**6) == 2 and fp.leading_blocks(10**10) == 3
    r = random.Random(3)
    rows = [r.getrandbits(63) for _ in range(100)]
    rows += [x ^ sum(1 << b for b in r.sample(range(63), 3)) for x in rows]
    df = spark.createDataFrame([(x, "c") for x in set(rows)], "f bigint, extra string")
    want = {(a, b, "c") for a in set(rows) for b in set(rows) if (a ^ b).bit_count() <= 3}
    for leading in (2, 3, 4):
        got = list(map(tuple, fp.within_radius(df.selectExpr("f as q"), df, leading=leading).collect()))
        assert set(got) == want and len(got) == len(want)


def test_single_and_empty(spark, empty):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id bigint, text string")
    r = fp.fingerprint_documents(one).first()
    assert r.n_chars == 15 and r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert fp.fingerprint_documents(empty).count() == 0
