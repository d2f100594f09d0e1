import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from kmerloom.llm import _text as T
from kmerloom.llm import importance as I

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) in plain Python, from zlib's CRC of each n-gram as a string."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = collections.Counter(bucket(f) for _, x in docs for f in features(x)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, x in docs:
        n, found = features(x)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def test_composed_crcs_equal_those_of_the_strings():
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abß0😀", k=r.choice([1, 2, 7, 40, 63, 64, 65, 200, 5000]))) for _ in range(r.randint(0, 30))) for _ in range(40)] + ["", None, "one"]
    for n in (1, 2, 4):
        for limit in (1 << 20, 1):
            data, offsets = T.utf8(pa.array(texts, pa.string()))
            got = collections.Counter()
            for i, j in T.runs(offsets, limit):
                part = data[offsets[i] : offsets[j]]
                starts, ends, doc = T.words(part, offsets[i : j + 1] - offsets[i], T.ALNUM)
                for crcs, own in I.ngram_crcs(I.word_crcs(part, starts, ends), ends - starts, doc, n):
                    got.update(zip((own + i).tolist(), crcs.tolist()))
            assert got == collections.Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in features(t, n)[1])


def test_shift_appends_zero_bytes():
    for length in (0, 1, 63, 64, 65, 127, 128, 100_000):
        data = b"some bytes"
        composed = I.shift(np.array([zlib.crc32(data)], np.uint32), np.array([length]))[0] ^ zlib.crc32(bytes(length))
        assert composed == zlib.crc32(data + bytes(length))


def test_query_equals_plain_rows(spark, odd, tmp_path):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(None, "") for _ in range(3)]
    docs += [(900 + k // 2, " ".join(f"w{(k // 2 * j) % 13}" for j in range(25))) for k in range(40)]
    target = [docs[k][1] for k in (0, 9, 12, 20)] + [None, "", "Æ B"]
    spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, who long, rank long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = I.op12_importance(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target)


def test_ties_are_ranked_across_ranges(spark):
    """A third of all rows share one id and text: every rank is given once, in the order of score and id."""
    docs = [(k if k % 3 else 5, " ".join(["same"] * 20 if k % 3 == 0 else [f"w{k}"] * 21)) for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = I.importance_resample(df, spark.createDataFrame([("same",)], "text string"), keep=["doc_id"], percent=60).collect()
    drawn = sorted((r.rank, -r.score, r.row.doc_id) for r in rows if r.rank)
    assert [r[0] for r in drawn] == list(range(1, 541)) and drawn == sorted(drawn, key=lambda r: r[1:])
    assert max(-d[1] for d in drawn) == max(r.score for r in rows)


def test_empty_tables_and_columns(spark, odd, empty):
    target = odd.select("text")
    assert I.importance_resample(empty, target).count() == 0
    out = I.importance_resample(odd, empty.select("text"))
    assert out.select("row.*").columns == odd.columns and out.count() == odd.count()
