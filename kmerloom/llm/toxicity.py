"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades are the labels' own values in order, 0 being clean; how severe a text is can be told apart only as far as the labels tell it
(labels with two values have one threshold, and the expected severity is then the probability of being toxic). The model is
the proportional-odds one: P(grade >= k) = sigmoid(w . x - threshold_k) with the same weights w for all
ordered thresholds; x has log(1 + count) of each selected word. Words are selected by a
significance test of their document frequency in toxic (above the least grade) against clean documents, after texts of a grade that agree in a
band of minwise word pairs (near copies) were reduced to one, so that a copied document does not make its words
indicative. The result is P(grade >= 1), the expected severity sum_k P(grade >= k) and the likeliest grade.

Clean and toxic documents weigh the same in all. The fit uses at most ``max_per_label`` labelled rows of each grade, taken in order of a hash of
doc_id, and never rows with crc32(doc_id as text) mod 4 = 2, which stay for held-out tests; the scores
cover all rows and whole texts. Texts of the sample are reduced to hashed counts by the executors; the driver gets the bands of
the sampled documents, the words that stand in significantly more toxic ones (each in at least ``z_least ** 2`` of the sample's) and the sample's counts of these.

Defined results: null, empty and wordless texts have no features and score as such; texts of any length are read whole; labels that are null, repeat or
belong to no document are ignored (of repeated labels, the greatest grade wins, negative ones count as 0); of documents that share a labelled id
one trains; without labels of two grades every score is 0. Repeated rows are scored each; other columns are never looked at and pass
through. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _text as T
from kmerloom.llm._common import kept, lean_batches, table

MAX_PER_LABEL = 3000
MAX_GRADES = 16
Z_LEAST = 6.0


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, count) of the distinct lower-cased words of each document, in order."""
    data = T.LOWER[data]
    starts, ends, doc = T.words(data, offsets, T.ALNUM)
    h = T.word_hashes(data, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each k from 1, as columns."""
        if not len(self.thresholds):
            return np.zeros((len(score), 1))
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def score(self, doc: np.ndarray, words: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
        if not len(self.words):
            return np.zeros(n_docs)
        k = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        own = self.words[k] == words
        return np.bincount(doc[own], self.weights[k[own]] * np.log1p(counts[own]), n_docs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int = 3, penalty: float = 1e-4, steps: int = 400, rate: float = 0.2, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the proportional-odds model, by Adam on the mean log loss.

    Thresholds are the first one plus exponentials of free numbers, so that they stay in order. ``weight``: of each
    row, adding up to 1 (by default all alike).
    """
    n, m = x.shape
    weight = np.full(n, 1 / n) if weight is None else weight
    w, t = np.zeros(m), np.concatenate([[1.0], np.zeros(n_grades - 2)])
    first, second = np.zeros(m + n_grades - 1), np.zeros(m + n_grades - 1)
    at = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(t[1:])
        theta = t[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        cum = np.ones((n, n_grades + 1))
        cum[:, 1:-1] = _sigmoid((x @ w)[:, None] - theta)
        cum[:, -1] = 0
        p = np.maximum(cum[at, grade] - cum[at, grade + 1], 1e-12)
        slope = cum * (1 - cum)
        g_score = -weight * (slope[at, grade] - slope[at, grade + 1]) / p
        g_theta = np.zeros(n_grades - 1)
        for k in range(1, n_grades):
            g_theta[k - 1] = (slope[:, k] * ((grade == k).astype(float) - (grade == k - 1)) * weight / p).sum()
        g_t = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * gaps[k - 1] for k in range(1, n_grades - 1)]])
        g = np.concatenate([x.T @ g_score + penalty * w, g_t])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:m], t - move[m:]
    return w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


BANDS, BAND = 6, 3
SAMPLE = "doc_id bigint, grade int, digest bigint, bands array<bigint>, words array<bigint>, counts array<bigint>"


def bands(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of the minwise word pairs of each band; 0 for texts of fewer than two words."""
    data = T.LOWER[data]
    starts, ends, doc = T.words(data, offsets, T.ALNUM)
    h = T.word_hashes(data, starts, ends)
    at = np.flatnonzero(doc[1:] == doc[:-1]) if len(h) else np.zeros(0, np.int64)
    pair, owner = T.mix(h[at] * T.U64(3) + h[at + 1]), doc[at]
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    for b in range(BANDS if len(begin) else 0):
        key = np.full(len(begin), b + 1, np.uint64)
        for r in range(BAND):
            key = T.mix(key * T.U64(0x9FB21C651E98DF25) + np.minimum.reduceat(T.mix(pair ^ T.U64(b * BAND + r + 1)), begin))
        out[owner[begin], b] = key
    return out


def one_of_copies(keys: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """True for the first document of each grade in every group that agrees in a band, directly or by way of others."""
    leader = np.arange(len(keys))
    seen: dict[tuple, int] = {}

    def root(k: int) -> int:
        while leader[k] != k:
            leader[k] = k = leader[leader[k]]
        return k

    for k, (own_keys, g) in enumerate(zip(keys.tolist(), grade.tolist())):
        for b, key in enumerate(own_keys):
            if key:
                other, own = root(seen.setdefault((b, key, g), k)), root(k)
                leader[max(own, other)] = min(own, other)
    return leader == np.arange(len(leader))


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        for i, j in T.runs(offsets):
            part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            doc, words, counts = word_counts(part, edges)
            begin = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
            digest = np.zeros(j - i, np.uint64)
            np.add.at(digest, doc, T.mix(words + counts.astype(np.uint64)))
            lists = [pa.ListArray.from_arrays(begin, pa.array(x.view(np.int64))) for x in (words, counts.astype(np.int64))]
            keys = pa.FixedSizeListArray.from_arrays(pa.array(bands(part, edges).ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in ("doc_id", "grade")], pa.array(digest.view(np.int64)), keys, *lists], ["doc_id", "grade", "digest", "bands", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, z_least: float = Z_LEAST) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents (see the module text)."""
    spark = docs.sparkSession
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    one = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.greatest(F.max(F.col("toxic").cast("int")), F.lit(0)).alias("value"))
    values = sorted(r["value"] for r in one.select("value").distinct().limit(MAX_GRADES + 1).collect())
    if len(values) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades")
    if len(values) < 2:
        return none
    picked = None
    for grade, value in enumerate(values):
        own = one.where(F.col("value") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label).select("doc_id", F.lit(grade).alias("grade"))
        picked = own if picked is None else picked.union(own)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")
    sample = kept(texts.mapInArrow(_featurizer, SAMPLE))
    # of documents that share an id the one with the least digest
    first = sample.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    heads = sample.join(first, ["doc_id", "digest"]).select("doc_id", "digest", "grade", "bands").where(F.size("bands") > 0).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().combine_chunks()
    if not heads.num_rows:
        return none
    ids, digest, grade = (heads.column(c).to_numpy() for c in ("doc_id", "digest", "grade"))
    chosen = one_of_copies(heads.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS), grade)
    ids, digest, grade = ids[chosen], digest[chosen], grade[chosen].astype(np.int64)
    n_pos, n_neg = int((grade > 0).sum()), int((grade == 0).sum())
    if not n_pos or not n_neg:
        return none
    rows = spark.createDataFrame(list(zip(range(len(ids)), ids.tolist(), digest.tolist())), "number int, doc_id bigint, digest bigint")
    used = sample.join(F.broadcast(rows), ["doc_id", "digest"]).dropDuplicates(["number"])
    words = used.select("number", "grade", F.inline(F.arrays_zip("words", "counts"))).toDF("number", "grade", "word", "count")
    # words that stand in significantly more toxic than clean documents
    frequency = words.groupBy("word").agg(F.count(F.when(F.col("grade") > 0, 1)).alias("pos"), F.count(F.when(F.col("grade") == 0, 1)).alias("neg"))
    share = (F.col("pos") + F.col("neg") + 1) / (n_pos + n_neg + 2)
    z = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg))
    selected = np.array([r["word"] for r in frequency.withColumn("z", z).where(F.col("z") >= z_least).orderBy(F.desc("z"), "word").select("word").collect()], np.int64)
    if not len(selected):
        return none
    vocabulary = np.sort(selected.view(np.uint64))
    listed = spark.createDataFrame([(w,) for w in selected.tolist()], "word bigint")
    cells = words.join(F.broadcast(listed), "word").select("number", "word", "count").toArrow()
    x = np.zeros((len(ids), len(vocabulary)))
    x[cells.column("number").to_numpy(), np.searchsorted(vocabulary, cells.column("word").to_numpy().view(np.uint64))] = np.log1p(cells.column("count").to_numpy())
    weights, thresholds = fit_ordinal(x, grade, len(values), weight=np.where(grade > 0, 0.5 / n_pos, 0.5 / n_neg))
    return OrdinalModel(vocabulary, weights, thresholds)


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: OrdinalModel = model.value
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            scores = [m.score(*word_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i) for i, j in T.runs(offsets)]
            p = m.at_least(np.concatenate(scores) if scores else np.zeros(0))
            exact = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], 1)
            out = [batch.column("row"), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(out, ["row", "p_toxic", "expected_severity", "grade", "toxic"])

    return score


def grade_toxicity(docs: DataFrame, model: OrdinalModel, keep: list[str] | None = None) -> DataFrame:
    """Columns row (those in ``keep``, all by default), p_toxic, expected_severity, grade, toxic."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep or docs.columns]).alias("row"), F.col("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared), f"row {kind}, p_toxic double, expected_severity double, grade int, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade_toxicity(docs, model, ["doc_id"]).select("row.doc_id", "p_toxic", "expected_severity", "grade", "toxic")
