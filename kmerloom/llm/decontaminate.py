"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive benchmark words (an item with fewer words is one
window); equal windows are one pattern with the list of its items. For each pattern length the classical tables are built once: a
block shift table (block of two words) that says how far a search position may move, and suffix-hash buckets that list the
patterns whose last block has that hash. Documents are cut into overlapping lanes; all lanes of a
chunk advance together, each by its own shift, so that impossible positions are never looked at.
Positions with shift 0 look up their bucket, and a direct comparison of all words confirms, by word number and
then byte by byte.

Patterns are places in one array of word numbers, and the hash tables have at most ``2**22`` entries, so that the tables of a
block of benchmark text are a small multiple of its bytes (``Patterns.nbytes``). They are broadcast only up to ``max_block_bytes`` of benchmark
text. A larger benchmark is dealt into blocks by item, searched one after another; each pass stores only the texts with hits (by 128
bits of hashes of the text), which are joined at the end.

Defined results: a null or empty text has no words (all counts 0); null item texts or items without
words are never found; repeated document rows give repeated result rows; items that repeat an id
count once; null item ids are ignored. Very long texts are searched whole, a text over 1 MiB as a chunk of its own. Extra columns are
never looked at. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _text as T
from kmerloom.llm._common import bytes_of, lean_batches, stored, table

LANE = 256
MOST_BITS = 22
_BLOCK = T.U64(0xD6E8FEB86659FD93)


def _block_hash(codes: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Hash of the block of words that ends at each place."""
    h = codes.astype(np.uint64)
    if block == 2 and len(h):
        h[1:] += codes[:-1].astype(np.uint64) * _BLOCK
    return (T.mix(h) >> T.U64(64 - bits)).astype(np.int32)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of the ranges, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WuManber:
    """Tables for patterns of ``m`` words that start at the places ``at`` in ``codes``; ``owner`` is the item of each."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, owner: np.ndarray, m: int):
        self.codes, self.m, self.block = codes, m, min(2, m)
        self.bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(max(1, len(at) * m)))) + 4))
        # equal windows are one pattern
        h = np.zeros(len(at), np.uint64)
        for k in range(m):
            h = T.mix(h * T.U64(0x9FB21C651E98DF25) + codes[at + k].astype(np.uint64))
        order = np.lexsort((owner, h))
        at, owner, h = at[order], owner[order], h[order]
        new = np.ones(len(at), bool)
        new[1:] = h[1:] != h[:-1]
        for k in range(m):
            new[1:] |= codes[at[1:] + k] != codes[at[:-1] + k]
        pattern = np.cumsum(new) - 1
        twice = np.zeros(len(at), bool)
        twice[1:] = ~new[1:] & (owner[1:] == owner[:-1])
        self.owner, self.owners_begin = owner[~twice], np.append(np.flatnonzero(new[~twice]), (~twice).sum()).astype(np.int32)
        self.at = at[new]
        del pattern, h, order
        blocks = _block_hash(codes, self.block, self.bits)
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int8 if m < 120 else np.int32)
        for end in range(self.block - 1, m):  # later ends have smaller shifts
            self.shift[blocks[self.at + end]] = m - 1 - end
        suffix = blocks[self.at + m - 1]
        order = np.argsort(suffix, kind="stable")
        self.at, sizes = self.at[order], np.diff(self.owners_begin)[order]
        self.owner = self.owner[_ranges(self.owners_begin[:-1][order].astype(np.int64), sizes)]
        self.owners_begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.bucket = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(suffix, minlength=1 << self.bits), out=self.bucket[1:])

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.at, self.owner, self.owners_begin, self.shift, self.bucket))

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and pattern numbers of all occurrences in a sequence of word codes."""
        n, m = len(codes), self.m
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        h = _block_hash(codes, self.block, self.bits)
        pos = np.arange(m - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(pos + LANE, n)
        found = []
        while len(pos):
            step = self.shift[h[pos]]
            hit = pos[step == 0]
            if len(hit):
                found.append(hit)
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return none, none
        ends = np.concatenate(found)
        lo = self.bucket[h[ends]].astype(np.int64)
        size = self.bucket[h[ends] + 1] - lo
        at, which = np.repeat(ends, size) - m + 1, _ranges(lo, size)
        for k in range(m):  # direct comparison, word by word
            same = codes[at + k] == self.codes[self.at[which] + k]
            at, which = at[same], which[same]
        return at, which

    def items(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of the patterns, and how many each has."""
        first = self.owners_begin[which].astype(np.int64)
        size = self.owners_begin[which + 1] - first
        return self.owner[_ranges(first, size)], size


class Patterns:
    """All windows of a block of benchmark items (ids and texts), by length; words are known by number."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        self.ids = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.ids)}
        item = np.array([number[x] for x in ids], np.int32)
        data, offsets = T.utf8(texts)
        data, offsets = T.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        found = []
        for i, j in T.runs(offsets):
            lo = offsets[i]
            part = data[lo : offsets[j]]
            starts, ends, doc = T.words(part, offsets[i : j + 1] - lo, T.ALNUM)
            found.append((starts + lo, ends + lo, (doc + i).astype(np.int32), T.word_hashes(part, starts, ends)))
        starts, ends, doc, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.uint64))
        del found
        self.hashes, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
        codes = (codes + 1).astype(np.int32)
        del hashes
        spelled = [data[s:e].tobytes() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        self.joined = np.frombuffer(b"".join(spelled), np.uint8)
        size = np.array([len(w) for w in spelled], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.twins = self._number_twins(data, starts, ends, codes)
        del starts, ends
        count = np.bincount(doc, minlength=len(ids))
        begin = np.cumsum(count) - count
        m = np.minimum(count, window)
        n_windows = np.where(count > 0, count - m + 1, 0)
        at = _ranges(begin, n_windows).astype(np.int32)
        owner, length = np.repeat(item, n_windows), np.repeat(m, n_windows)
        self.codes = codes
        self.tables = [WuManber(codes, at[length == k], owner[length == k], int(k)) for k in np.unique(length)]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.codes, self.hashes, self.joined, self.starts, self.ends)) + sum(t.nbytes() for t in self.tables)

    def _number_twins(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> dict[int, list[int]]:
        """Gives words that share a hash with another benchmark word numbers of their own, beyond those of the hashes: by the hash's number, its further numbers."""
        own: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(~self.alike(data, starts, ends, codes)).tolist():
            key = int(codes[k]), data[starts[k] : ends[k]].tobytes()
            codes[k] = own.setdefault(key, len(self.hashes) + 1 + len(own))
        if own:
            size = np.array([len(word) for _, word in own], np.int64)
            self.joined = np.concatenate([self.joined, np.frombuffer(b"".join(word for _, word in own), np.uint8)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            self.starts = np.concatenate([self.starts, self.ends[-len(size) :] - size])
        twins: dict[int, list[int]] = {}
        for (first, _), code in own.items():
            twins.setdefault(first, []).append(code)
        return twins

    def word_numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of words: by hash, and by spelling where benchmark words share a hash; 0 for words outside the benchmark."""
        codes = self.numbers(T.word_hashes(data, starts, ends))
        for first, others in self.twins.items():
            at = np.flatnonzero(codes == first)
            for code in others:
                codes[at[self.alike(data, starts[at], ends[at], np.full(len(at), code))]] = code
        return codes

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers by hash, 0 for words outside the benchmark."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, k + 1, 0).astype(np.int32)

    def alike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether each word is, byte for byte, the benchmark's word of that number."""
        c = codes - 1
        size = ends - starts
        same = size == self.ends[c] - self.starts[c]
        for part in np.array_split(np.flatnonzero(same), 1 + int(size[same].sum()) // T.CHUNK):
            own = size[part]
            differ = data[_ranges(starts[part], own)] != self.joined[_ranges(self.starts[c[part]], own)]
            same[part[np.repeat(np.arange(len(part)), own)[differ]]] = False
        return same


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of sorted (start, end) word spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])]], 1)


def _searcher(patterns, only_hits: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Patterns = patterns.value
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            counts, hits, items = [], [], []
            for i, j in T.runs(offsets):
                lo = offsets[i]
                part = T.LOWER[data[lo : offsets[j]]]
                starts, ends, doc = T.words(part, offsets[i : j + 1] - lo, T.ALNUM)
                n = np.bincount(doc, minlength=j - i)
                counts.append(n)
                base = np.cumsum(n) - n
                codes = p.word_numbers(part, starts, ends)
                spans: list[list] = [[] for _ in range(j - i)]
                owners: list[list] = [[] for _ in range(j - i)]
                # a gap of code -1 between documents, so that no window crosses them
                spread = np.full(len(codes) + j - i, -1, np.int32)
                spread[np.arange(len(codes)) + doc] = codes
                for t in p.tables:
                    at, which = t.search(spread)
                    d = np.searchsorted(base + np.arange(j - i), at, "right") - 1
                    w = at - d
                    if len(w):
                        at_words = (w[:, None] + np.arange(t.m)).ravel()
                        seen, back = np.unique(at_words, return_inverse=True)
                        good = p.alike(part, starts[seen], ends[seen], codes[seen])[back].reshape(-1, t.m).all(1)
                        d, w, which = d[good], w[good], which[good]
                    for k in np.unique(d):
                        own = d == k
                        s = w[own] - base[k]
                        spans[k].append(np.stack([s, s + t.m], 1))
                        owners[k].append(np.unique(t.items(np.unique(which[own]))[0]))
                for k in range(j - i):
                    hits.append(_merge(np.concatenate(spans[k])).ravel().tolist() if spans[k] else [])
                    items.append(sorted(p.ids[x] for x in np.unique(np.concatenate(owners[k]))) if owners[k] else [])
            n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            names = [c for c in batch.schema.names if c != "text"]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "hits", "items"])
            yield out.filter(pa.array([len(h) > 0 for h in hits], pa.bool_())) if only_hits else out

    return search


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the hits and items of all blocks."""
    for batch in batches:
        hits, items = [], []
        for h, more, known, others in zip(*(batch.column(c).to_pylist() for c in ("hits", "more_hits", "items", "more_items"))):
            both = np.array([*h, *(more or ())], np.int64).reshape(-1, 2)
            hits.append(_merge(both).ravel().tolist() if len(both) else [])
            items.append(sorted({*known, *(others or ())}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])


RESULT = "n_words bigint, hits array<bigint>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_block_bytes: int = 16 << 20) -> DataFrame:
    """Per document: doc_id, n_words, hits (flat start, end word spans, merged), items (ids as strings, sorted)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item is not null")
    n_blocks = max(1, -(-bytes_of(bench, F.col("text")) // max_block_bytes))

    def tables(b: int):
        block = (bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)).toArrow()
        return spark.sparkContext.broadcast(Patterns(block.column("item").to_pylist(), pa.concat_arrays([c.cast(pa.large_string()) for c in block.column("text").chunks] or [pa.array([], pa.large_string())]), window))

    kind = docs.schema["doc_id"].dataType.simpleString()
    if n_blocks == 1:
        return docs.select("doc_id", "text").mapInArrow(_searcher(tables(0), False), f"doc_id {kind}, {RESULT}")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    more = None
    for b in range(1, n_blocks):
        own = tables(b)
        found = stored(keyed.drop("doc_id").mapInArrow(_searcher(own, True), f"h1 bigint, h2 bigint, {RESULT}").select("h1", "h2", "hits", "items").hint("rebalance"), "decontaminate")
        own.destroy()
        more = found if more is None else more.union(found)
    # repeated texts have the same hits
    more = more.groupBy("h1", "h2").agg(F.flatten(F.collect_set("hits")).alias("more_hits"), F.flatten(F.collect_set("items")).alias("more_items"))
    first = keyed.mapInArrow(_searcher(tables(0), False), f"doc_id {kind}, h1 bigint, h2 bigint, {RESULT}")
    joined = first.join(more, ["h1", "h2"], "left").select("doc_id", "n_words", "hits", "items", "more_hits", "more_items")
    return joined.mapInArrow(_merger, f"doc_id {kind}, {RESULT}")


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts and digests from :func:`find_contamination`."""
    covered = F.expr("aggregate(sequence(0, cast(size(hits) / 2 as int) - 1), 0L, (a, i) -> a + hits[2 * i + 1] - hits[2 * i])")
    n_hit = F.when(F.size("hits") > 0, covered).otherwise(F.lit(0).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with all their columns.

    Contaminated rows are dropped by row, so rows that share an id or are repeated are judged each
    on its own text.
    """
    flat = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    found = find_contamination(flat, benchmark, **options)
    return found.where(F.size("hits") == 0).select("doc_id.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return contamination_report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM bw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS gram
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, lengths WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, g.m, k FROM grams g JOIN windows USING (m, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
