"""Quality scores by histogram gradient-boosted trees over document statistics.

Each text becomes a row of statistics (shares of byte classes, word and line shape, repetition).
Trees are grown level by level on 64-bin histograms with logistic loss, then flattened into arrays
(feature, threshold, children, value) that numpy walks for all documents of a batch at once.

The fit uses at most ``max_rows`` labelled rows in order of a hash of doc_id, and never rows with
crc32(doc_id as text) mod 4 = 2. Only the text enters a score.

Defined results: null and empty texts have all statistics 0 and get the score of that row; null labels are
ignored, of repeated labels the larger counts; without labels of both kinds, every score is 0.5. Repeated
rows are scored each; of documents that share a labelled id one trains. A null doc_id is not held out. Texts over 1 MiB are whole
rows of statistics like any other. Other columns are never looked at. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _text as T
from kmerloom.llm._common import lean_batches, table

MAX_ROWS = 20_000
CUT = 0.7
N_BINS = 64
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space and tab, 5 line end, 6 lead byte of a longer
#: code point, 7 continuation byte, 8 sentence mark, 9 comma-like, 10 quote or bracket, 11 control.
CLASSES = 12
_CLASS = np.zeros(256, np.int64)
_CLASS[:32] = 11
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 1, 2, 3, 4, 5
_CLASS[192:], _CLASS[128:192] = 6, 7
_CLASS[list(b".!?")], _CLASS[list(b",;:-")], _CLASS[list(b"'\"()[]{}<>")] = 8, 9, 10


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _repeats(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest value of each document."""
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(n_docs)
    np.maximum.at(most, d[new], np.diff(np.concatenate([new, [len(h)]])))
    return np.bincount(d[new], minlength=n_docs).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features) statistics of whole texts."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    starts, ends, doc = T.words(data, offsets, T.NON_SPACE)
    n_words = np.bincount(doc, minlength=n).astype(float)
    long = (ends - starts).astype(float)
    mean = _ratio(np.bincount(doc, long, n), n_words)
    spread = np.sqrt(np.maximum(0, _ratio(np.bincount(doc, long**2, n), n_words) - mean**2))
    h = T.word_hashes(data, starts, ends)
    distinct, common = _repeats(h, doc, n)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    pairs = np.bincount(doc[pair], minlength=n).astype(float)
    pair_distinct, pair_common = _repeats(T.mix(h[pair] * T.U64(3) + h[pair + 1]), doc[pair], n)
    upper, lower = _CLASS[data] == 2, _CLASS[data] == 1
    total_upper, total_lower = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(lower)])
    word_upper, word_lower = total_upper[ends] - total_upper[starts], total_lower[ends] - total_lower[starts]
    shout = np.bincount(doc, (word_upper > 1) & (word_lower == 0), n)
    title = np.bincount(doc, upper[starts] & (word_lower > 0), n)
    last = _CLASS[data[ends - 1]]
    odd_end = np.bincount(doc, (last == 0) | (data[ends - 1] == 33), n)
    stop_end = np.bincount(doc, last == 8, n)
    alone = np.bincount(doc, (long <= 2) & (last == 0), n)
    line_kind = np.ones(256, np.uint8)
    line_kind[10] = 0
    ls, le, ldoc = T.words(data, offsets, line_kind)
    n_lines = np.bincount(ldoc, minlength=n).astype(float)
    line_distinct, line_common = _repeats(T.word_hashes(data, ls, le), ldoc, n)
    stopped = np.bincount(ldoc, _CLASS[data[le - 1]] == 8, n)
    columns = [np.log1p(sizes), np.log1p(n_words), np.log1p(n_lines), mean, spread, _ratio(distinct, n_words), _ratio(common, n_words), _ratio(pair_distinct, pairs), _ratio(pair_common, pairs)]
    columns += [_ratio(x, n_words) for x in (shout, title, odd_end, stop_end, alone)]
    columns += [_ratio(line_distinct, n_lines), _ratio(line_common, n_lines), _ratio(stopped, n_lines), _ratio(n_words, n_lines)]
    columns += [_ratio(classes[:, k], sizes) for k in range(CLASSES)]
    return np.stack(columns, 1)


@dataclass
class Forest:
    """Flattened trees: node k of tree t sends a row left where feature <= threshold; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                low = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(low, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: float = 1.0, l2: float = 1.0) -> Forest:
    n, m = x.shape
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    forest = Forest(np.zeros(shape, np.int64), np.full(shape, np.inf), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), 0.0, depth)
    if n == 0 or y.min() == y.max():
        forest.feature, forest.threshold, forest.left, forest.right, forest.value = (a[:0] for a in (forest.feature, forest.threshold, forest.left, forest.right, forest.value))
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, N_BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], 1)
    forest.base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, forest.base)
    flat = binned + np.arange(m) * N_BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            live = np.flatnonzero((node >= first) & (node < first + width))
            if not len(live):
                break
            key = ((node[live] - first)[:, None] * (m * N_BINS) + flat[live]).ravel()
            size = width * m * N_BINS
            gs = np.bincount(key, np.repeat(g[live], m), size).reshape(width, m, N_BINS).cumsum(2)
            hs = np.bincount(key, np.repeat(h[live], m), size).reshape(width, m, N_BINS).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), N_BINS)
                if gain[k, f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                at = first + k
                forest.feature[t, at], forest.threshold[t, at] = f, edges[f][b]
                forest.left[t, at], forest.right[t, at] = 2 * at + 1, 2 * at + 2
                own = live[node[live] == at]
                node[own] = np.where(binned[own, f] <= b, 2 * at + 1, 2 * at + 2)
        gn, hn = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        forest.value[t] = -rate * gn / (hn + l2)
        score += forest.value[t, node]
    return forest


def _per_batch(finish):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for i, j in T.runs(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield finish(batch.slice(i, j - i), x)

    return work


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Forest:
    """Fit on a bounded sample of labelled documents (see the module text)."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def finish(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_per_batch(finish), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>")
    # of documents that share an id one trains
    rows = joined.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("first")).select("first.x", "first.y").toArrow()
    n = rows.num_rows
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort(np.vstack([y, x.T]))  # sums of gradients do not depend on the order in which rows arrive
    return fit_forest(x[order], y[order], **options)


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def finish(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.predict(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(_per_batch(finish), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
