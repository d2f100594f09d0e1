import hashlib

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.llm import suffix_dedup as sd


def brute(rows, length):
    """Removed bytes of each document by a set of seen strings, in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if (s := b[p : p + length]) in seen:
                gone[p : p + length] = True
            else:
                seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_equals_brute_force(odd, hot):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = brute(rows, 100)
    got = sd.suffix_dedup(odd, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 500


def test_short_length_and_small_gram(spark):
    texts = ["abcabcabcabd" * 9, "xxabcabcabcab" * 5, "", "q"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute(list(enumerate(texts)), 20)
    for r in sd.suffix_dedup(docs, length=20, gram=6).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_empty(empty):
    assert sd.suffix_dedup(empty).count() == 0


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    tokens = [r.integers(0, 5, 30_000), r.integers(0, 50, 30_000), r.integers(0, 1000, 30_000)]
    order = sd.multikey_quicksort(tokens, cutoff=16)
    assert np.array_equal(np.stack(tokens)[:, order], np.stack(tokens)[:, np.lexsort(tokens[::-1])])


def test_long_document_in_pieces(monkeypatch):
    data = np.frombuffer(np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8).tobytes(), np.uint8)
    monkeypatch.setattr(sd, "PIECE", 1024)
    windows = []
    for part, edges, docs, firsts in sd.pieces(data, np.array([0, 5000]), 100):
        found = sd.anchors(part, edges)
        windows += [(firsts[0] + s, firsts[0] + e) for s, e in zip(found["start"], found["last"])]
    covered = sorted(p for s, e in windows for p in range(s, e + 1))
    assert covered == list(range(4901))


def test_place_splits_a_frequent_gram():
    s = (np.array([5, 7, 7, 9], np.uint64), np.array([3, 2, 8, 1], np.uint64))
    gram, context = np.array([1, 5, 5, 7, 7, 7, 9, 10], np.uint64), np.array([0, 2, 3, 1, 2, 9, 0, 0], np.uint64)
    assert sd.place(s, gram, context).tolist() == [sum((a, b) <= (g, c) for a, b in zip(*s)) for g, c in zip(gram, context)]


def windows_of(texts, length):
    """Brute form: windows that also start earlier, as a set of (id, start)."""
    seen, out = set(), set()
    for i, t in texts:
        for p in range(len(t) - length + 1):
            (out.add((i, p)) if t[p : p + length] in seen else seen.add(t[p : p + length]))
    return out


def spans_as_windows(batches, length):
    found = [x for b in batches for x in b.to_pylist() if x["s"] is not None]
    return {(x["id"], p) for x in found for p in range(x["s"], x["e"] - length + 1)}


@pytest.mark.parametrize("equal_hashes", [False, True])
def test_windows_are_compared_byte_by_byte(monkeypatch, equal_hashes):
    """All hashes forced to be equal: only the bytes tell windows apart."""
    if equal_hashes:
        monkeypatch.setattr(sd.T, "mix", lambda x: np.zeros(len(x), np.uint64))
    r = np.random.default_rng(8)
    texts = [(k, r.integers(97, 99, 40).astype(np.uint8).tobytes()) for k in range(30)]
    column = lambda values, kind: pa.array(values, kind)
    none = pa.nulls(len(texts), pa.int64())
    batch = pa.RecordBatch.from_arrays([column([0] * 30, pa.int64()), column([i for i, _ in texts], pa.int64()), column([7] * 30, pa.int64()), column([0] * 30, pa.int64()), column([t for _, t in texts], pa.binary()), none, none], sd.CONTEXT_NAMES)
    got = spans_as_windows(sd._window_comparer(8)(iter([batch])), 8)
    assert got == windows_of(texts, 8) and got


def test_hot_windows_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(sd.T, "mix", lambda x: np.zeros(len(x), np.uint64))
    r = np.random.default_rng(9)
    texts = [(k, r.integers(97, 99, 30).astype(np.uint8).tobytes()) for k in range(10)]
    ats = [[int(~sd._at(np.int64(0), np.int64(0), np.int64(30 - 8)))] for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([1] * 10, pa.int64()), pa.array([t.decode() for _, t in texts]), pa.array(ats, pa.list_(pa.int64()))], ["id", "row", "text", "ats"])
    out = list(sd._contexts(8, 4)(iter([batch])))
    want = windows_of(texts, 8)
    assert spans_as_windows(out, 8) == want and want
    left = {(x["id"], x["start"]) for b in out for x in b.to_pylist() if x["s"] is None}
    assert left == {(i, p) for i, t in texts for p in range(23)} - want


def test_text_longer_than_a_piece(spark):
    """A text over 1 MiB with a repeat across the edge of its pieces, against the brute form."""
    r = np.random.default_rng(12)
    long = bytearray(r.integers(97, 123, sd.PIECE + 5000).astype(np.uint8).tobytes())
    long[sd.PIECE - 150 : sd.PIECE + 150] = long[1000:1300]
    rows = [(1, long.decode()), (2, "q" + long[sd.PIECE - 300 : sd.PIECE + 900].decode())]
    want = brute(rows, 100)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and want[1][1] == 300 and want[2][1] == 1200
