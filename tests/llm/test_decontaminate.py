import hashlib
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from kmerloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        m = min(10, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == b[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def items_of(odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    return [(1, " ".join(texts[11].split()[5:40])), (2, texts[101].upper()), (10, "x"), (3, ""), (4, None), (5, "ab AB ab"), (9, "never, ever seen words 123"), (None, texts[11]), (2, texts[102])]


def test_equals_brute_force(spark, odd):
    items = items_of(odd)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    own = [x for x in items if x[0] is not None]
    for block in (32 << 20, 100):
        got = dc.contamination_report(dc.find_contamination(odd, bench, max_block_bytes=block)).collect()
        want = [(r.doc_id, *brute(r.text, own)) for r in odd.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_filter_keeps_clean_documents(spark, odd, empty):
    bench = spark.createDataFrame(items_of(odd)[:1], "item_id bigint, text string")
    left = dc.decontaminate(odd, bench)
    assert left.columns == odd.columns
    bad = {8, 9, 11}
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(r.doc_id or 0 for r in odd.collect() if r.doc_id not in bad)
    assert dc.decontaminate(empty, bench).count() == 0
    assert dc.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_wu_manber_tables_skip():
    t = dc.WuManber(np.arange(11, dtype=np.int32), np.array([1], np.int32), np.array([7], np.int32), 10)
    assert t.shift.max() == 9 and t.shift.min() == 0
    at, which = t.search(np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1, 2], np.int32))
    assert at.tolist() == [2] and which.tolist() == [0] and t.items(which)[0].tolist() == [7]


def test_equal_windows_are_one_pattern():
    passage = " ".join(f"w{k}" for k in range(12))
    p = dc.Patterns([str(k) for k in range(500)], pa.array([passage] * 500, pa.large_string()), 10)
    (t,) = p.tables
    assert len(t.at) == 3 and len(t.owner) == 1500


def test_tables_are_a_small_multiple_of_the_text():
    """4 MB of benchmark: the tables stay under 12 bytes per byte, whatever is fixed included."""
    r = np.random.default_rng(4)
    words = np.array([f"w{k:x}" for k in range(40_000)])
    texts = [" ".join(words[r.integers(0, 40_000, 400)]) for _ in range(1700)]
    size = sum(len(x) for x in texts)
    p = dc.Patterns([str(k) for k in range(len(texts))], pa.array(texts, pa.large_string()), 10)
    assert size > 3_500_000 and p.nbytes() < 12 * size
    probe = texts[5].split()[100:140]
    data = np.frombuffer((" ".join(["zz", *probe, "zz"])).encode(), np.uint8)
    starts, ends, _ = dc.T.words(data, np.array([0, len(data)]), dc.T.ALNUM)
    at, which = p.tables[0].search(p.numbers(dc.T.word_hashes(data, starts, ends)))
    assert sorted(at.tolist()) == list(range(1, 32)) and {p.ids[x] for x in p.tables[0].items(which)[0]} == {"5"}


def test_a_text_over_a_chunk(spark):
    """A window at the very end of a text of over 1 MiB is found."""
    window = " ".join(f"needle{k}" for k in range(10))
    long = prose(5, 250_000, 40_000) + " " + window
    assert len(long.encode()) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, "x " + window + " y")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, window)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, list(r.hits)) for r in dc.find_contamination(docs, bench).collect()}
    n = len(words(long))
    assert got == {1: (n, [n - 10, n]), 2: (12, [1, 11])}


@pytest.mark.parametrize("kinds", [1, 7])
def test_words_of_one_hash_are_told_apart(monkeypatch, kinds):
    """All words share one hash, or seven: the rows are those of the brute force."""
    plain = dc.T.word_hashes
    monkeypatch.setattr(dc.T, "word_hashes", lambda *args: plain(*args) % np.uint64(kinds))
    r = np.random.default_rng(8)
    draw = lambda n: " ".join(f"w{k}" for k in r.integers(0, 30, n))
    passages = [draw(n) for n in (10, 14, 3, 25)]
    items = list(enumerate(passages))
    texts = [draw(50), "w99 w1", "", f"{draw(20)} {passages[1]} w77", f"w400 {passages[0]} {passages[2]}", passages[3][4:]]
    p = dc.Patterns([str(k) for k, _ in items], pa.array(passages, pa.large_string()), 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.large_string())], ["doc_id", "text"])
    (out,) = dc._searcher(SimpleNamespace(value=p), False)(iter([batch]))
    for text, row in zip(texts, out.to_pylist()):
        spans = np.array(row["hits"]).reshape(-1, 2)
        n_words, n_hit, n_items, _, _ = brute(text, items)
        assert (row["n_words"], int((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0, len(row["items"])) == (n_words, n_hit, n_items)
