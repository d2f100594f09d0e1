"""Periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period q that cannot be extended with that period. Every run
holds a Lyndon root: for one of the two orders of the words, the longest Lyndon word that starts at some place of the run is its period. So:

1. Words are numbered; a suffix array (prefix doubling) and its inverse give the order of all suffixes, the end of the text being less than any word.
2. The longest Lyndon word at a place ends before the next smaller value of the inverse suffix array, for the reversed order before the next greater one.
3. Each such word (place, period) is a root candidate; it is extended to both sides by longest common extensions: minima of the LCP array between two
   suffixes, by blocks with a sparse table over the blocks' minima, and the same on the reversed text for the extension to the left.
4. Candidates that extend to two periods are runs; equal (start, period) are one run.

Here runs of at least ``max(LEAST, POWER * q)`` words count. Such a run repeats a stretch of ``LEAST - LEAST // POWER`` words within the
document; documents where no such stretch repeats (by rolling hashes of all stretches, so that nothing is missed) are not searched further.

Scale. Documents are independent: one scan, nothing is shuffled, whole texts, one at a time in a task. A document of n words takes a few hundred n bytes while it is searched,
which bounds its memory by its own length; the sparse tables are over blocks of ``BLOCK`` values.

Defined results: a null or empty text has no words, no runs and the digest of the empty text; a null doc_id counts as the empty id where the planted
periods are made; equal rows give equal rows; ties of exponent go to the smallest start, then the smallest period; other columns, whatever
their names, are not looked at. An empty table gives an empty table. Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm._common import lean_batches, table
from kmerloom.llm._text import mix

LEAST = 24
POWER = 3
BLOCK = 16


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a text of whole numbers and its inverse, by prefix doubling; the end is less than any number."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    h = 1
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] if h < n else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rank = fresh
        if rank[order[-1]] == n or h >= n:
            return order, rank - 1
        h *= 2


def lcp_array(codes: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """LCP of each suffix of the array with the one before it (0 for the first), in text order amortised."""
    n = len(codes)
    out, held = [0] * n, 0
    text, before, ranks = codes.tolist(), order.tolist(), place.tolist()
    for i in range(n):
        r = ranks[i]
        if r:
            j = before[r - 1]
            most = n - max(i, j)
            while held < most and text[i + held] == text[j + held]:
                held += 1
            out[r] = held
            held -= held > 0
        else:
            held = 0
    return np.array(out, np.int64)


class RangeMinimum:
    """Minima of ranges: running minima to both ends of each block, a sparse table over the blocks, a scan within one block."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = np.pad(values, (0, -n % BLOCK), constant_values=np.iinfo(values.dtype).max)
        blocks = self.values.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(blocks, 1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while 2 << (len(self.levels) - 1) <= len(blocks):
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[: len(low) - step], low[step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of the values lo, lo + 1 ... hi (lo <= hi)."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.since[lo], self.upto[hi])
        between = np.flatnonzero(last - first > 1)
        a, size = first[between] + 1, last[between] - first[between] - 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            s = self.levels[k]
            at = between[own]
            out[at] = np.minimum(out[at], np.minimum(s[a[own]], s[a[own] + size[own] - (1 << int(k))]))
        inside = np.flatnonzero(first == last)
        if len(inside):
            a, b = lo[inside], hi[inside]
            least = self.values[a]
            for k in range(1, BLOCK):
                least = np.where(a + k <= b, np.minimum(least, self.values[np.minimum(a + k, len(self.values) - 1)]), least)
            out[inside] = least
        return out


def extensions(order: np.ndarray, place: np.ndarray, codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of places i < j: how many words from i on equal those from j on (j may be the end)."""
    n = len(codes)
    minimum = RangeMinimum(lcp_array(codes, order, place))

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        some = np.flatnonzero((j < n) & (i < n))
        a, b = place[i[some]], place[j[some]]
        out[some] = minimum(np.minimum(a, b) + 1, np.maximum(a, b))
        return out

    return common


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next place with a smaller value, or the length."""
    n = len(values)
    out, stack = [n] * n, []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] > v:
            out[stack.pop()[1]] = i
        stack.append((v, i))
    return np.array(out, np.int64)


def lyndon_roots(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest Lyndon word at each place under both orders.

    Under the reversed order the end is greater than any word; a word that only the end stops is none.
    """
    n = len(place)
    at = np.arange(n)
    down, up = next_smaller(place), next_smaller(-place)
    stopped = up < n
    return np.concatenate([at, at[stopped]]), np.concatenate([down - at, (up - at)[stopped]])


def all_runs(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """(start, length, period) of all runs of at least ``max(least, power * period)`` words, by start, then period."""
    n = len(codes)
    none = np.zeros((0, 3), np.int64)
    if n < max(least, power):
        return none
    order, place = suffix_array(codes)
    start, period = lyndon_roots(place)
    # A root of a run of ``power`` >= 2 periods is repeated in part to one side at least.
    after, before = start + period, start + period - 1
    right = (after < n) & (codes[np.minimum(after, n - 1)] == codes[start])
    left = (start > 0) & (codes[before] == codes[np.maximum(start - 1, 0)])
    some = (right | left) & (power * period <= n)
    start, period = start[some], period[some]
    if not len(start):
        return none
    right = extensions(order, place, codes)(start, start + period)
    back = codes[::-1].copy()
    left = extensions(*suffix_array(back), back)(n - start - period, n - start)
    begin, end = start - left, start + period + right
    good = (end - begin >= np.maximum(least, power * period)) & (end - begin >= 2 * period)
    return np.unique(np.stack([begin, period, end - begin], 1)[good], axis=0)[:, [0, 2, 1]]


def may_have_runs(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> bool:
    """Whether some stretch of ``least - least // power`` words occurs twice, as any run of that size needs; by 64-bit hashes, so it may say yes too often, never no."""
    size = least - least // power
    n = len(codes) - size + 1
    if n < 2:
        return False
    have, width, out, done = mix(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while size >> (width.bit_length() - 1):
        if size & width:
            part = have[done : done + n]
            out = part if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += width
        if 2 * width > size:
            break
        have = mix(have[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + have[width:])
        width *= 2
    out = np.sort(out)
    return bool((out[1:] == out[:-1]).any())


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties go to the smallest start, then period."""
    return max(map(tuple, runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def planted(who: str, n: int) -> np.ndarray | None:
    """The query's planted periods: which word of the text stands at each of n places, or None where the text stays as it is."""
    h = zlib.crc32(who.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


RESULT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str | None = None, plant: bool = False, least: int = LEAST, power: int = POWER) -> DataFrame:
    """All columns in a struct ``row``, with n_words, runs, best and collapsed: the text without the words that repeat a run's first period.

    ``plant`` puts periods into a tenth of the texts, by their id, before they are searched.
    """
    who = F.coalesce(F.col(id_col).cast("string"), F.lit("")) if id_col else F.lit("")
    keep = [c for c in docs.columns if c != text_col]
    plain = docs.select(F.struct(*[F.col(c) for c in keep] or [F.lit(None).alias("none")]).alias("row"), who.alias("who"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column("who"), batch.column("text").cast(pa.large_string()).cast(pa.large_binary())):
                words = (text.as_py() or b"").split()
                order = planted(name.as_py(), len(words)) if plant else None
                if order is not None:
                    words = [words[k] for k in order.tolist()]
                number: dict[bytes, int] = {}
                codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                runs = all_runs(codes, least, power) if may_have_runs(codes, least, power) else np.zeros((0, 3), np.int64)
                if len(runs):
                    words = [words[k] for k in np.flatnonzero(~repeated(runs, len(words))).tolist()]
                out.append((len(codes), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], None if not len(runs) else dict(zip(("start", "length", "period"), best_run(runs))), b" ".join(words)))
            n, runs, best, texts = zip(*out) if out else ((), (), (), ())
            arrays = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(best, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", "n_words", "runs", "best", "collapsed"])

    return plain.mapInArrow(search, f"row {plain.schema['row'].dataType.simpleString()}, {RESULT}")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs, id_col="doc_id", plant=True)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "row.doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
