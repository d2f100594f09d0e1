"""Importance resampling towards a target distribution, on hashed n-grams whose hashes are composed by CRC algebra.

*Features.* All runs of 1 to ``n`` successive words; a feature's bucket is the CRC-32 of its UTF-8 bytes, joined by spaces, modulo
``buckets``. No n-gram string is ever made: a word's CRC is computed once, and ``crc(a + b) = shift(crc(a), len(b)) xor crc(b)``, where
``shift`` by some bytes is a 32 x 32 matrix over GF(2). The matrices of up to 63 bytes are kept as tables of four lookups, those of 64 * 2**k bytes
are squares of one another, so words of any length are composed.

*Weights.* Spark adds up the buckets' counts over all documents and all target texts. A bucket's gain is the floored
logarithm (in thousandths) of its smoothed odds; a document's weight is the floored mean gain of its features.

*Draw.* Gumbel noise from a digest of the id is added to the weight; of the documents with at least ``least_words`` words the highest
``percent`` of 100 scores are drawn, without replacement. Ranks come from one range-partitioned sort of a narrow table: rows are numbered within
each range and the ranges' counts are added up, so no task orders all rows.

Scale. Two scans of the text, nothing of it is shuffled. What a task gathers is ``buckets`` counts; the driver holds ``buckets`` gains.

Defined results: null and empty texts have no words, weight 0 and are never drawn; a null id draws by the digest of the empty id and comes last among
equal scores; rows with the same id share their noise, and equal rows are ranked in any order; texts of any length are read whole; an empty table of documents
gives an empty result, an empty target has counts of 0. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm import _text as T
from kmerloom.llm._common import lean_batches, partitions, stored, table

BUCKETS = 10_000
NGRAM = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Longest word whose CRC is computed in lanes; shifts by fewer bytes are single lookups.
LANE = 64
U32 = np.uint32


@lru_cache
def byte_table() -> np.ndarray:
    """The remainders of the 256 bytes."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & U32(1), (c >> U32(1)) ^ U32(POLYNOMIAL), c >> U32(1))
    return c


def _lookups(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given as the images of the 32 bits, as (4, 256) lookups by byte."""
    out = np.zeros((4, 256), np.uint32)
    for b in range(4):
        for bit in range(8):
            out[b] ^= np.where(np.arange(256) >> bit & 1, columns[8 * b + bit], U32(0))
    return out


def apply(lookups: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The matrix times each of many vectors."""
    return lookups[0][crc & U32(255)] ^ lookups[1][crc >> U32(8) & U32(255)] ^ lookups[2][crc >> U32(16) & U32(255)] ^ lookups[3][crc >> U32(24)]


_BITS = U32(1) << np.arange(32, dtype=np.uint32)


@lru_cache
def short_shifts() -> np.ndarray:
    """(LANE, 4, 256): the matrices that append 0 to LANE - 1 zero bytes."""
    one = _lookups((_BITS >> U32(8)) ^ byte_table()[_BITS & U32(255)])
    columns, out = _BITS, []
    for _ in range(LANE):
        out.append(_lookups(columns))
        columns = apply(one, columns)
    return np.stack(out)


@lru_cache
def long_shift(k: int) -> np.ndarray:
    """The matrix that appends LANE * 2**k zero bytes: a square of the one before."""
    half = short_shifts()[LANE // 2] if k == 0 else long_shift(k - 1)
    return _lookups(apply(half, apply(half, _BITS)))


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs moved on by ``length`` bytes each."""
    t, low = short_shifts(), length % LANE
    out = t[low, 0, crc & U32(255)] ^ t[low, 1, crc >> U32(8) & U32(255)] ^ t[low, 2, crc >> U32(16) & U32(255)] ^ t[low, 3, crc >> U32(24)]
    far = np.flatnonzero(length >= LANE)
    high, k = length[far] // LANE, 0
    while len(far):
        odd = far[high % 2 == 1]
        out[odd] = apply(long_shift(k), out[odd])
        high, k = high // 2, k + 1
        far, high = far[high > 0], high[high > 0]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word: byte by byte in lanes over all words; long words one by one."""
    t, size = byte_table(), ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(size <= LANE)
    for k in range(LANE):
        live = live[size[live] > k]
        if not len(live):
            break
        c = crc[live]
        crc[live] = (c >> U32(8)) ^ t[(c ^ data[starts[live] + k]) & U32(255)]
    crc = ~crc
    for w in np.flatnonzero(size > LANE).tolist():
        crc[w] = zlib.crc32(data[starts[w] : ends[w]])
    return crc


def ngram_crcs(words: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int = NGRAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, documents) of all runs of 1, 2 ... ``n`` words of a document, from the words' CRCs, bytes and documents."""
    space = U32(zlib.crc32(b" "))
    one = short_shifts()[1]
    have = words
    for k in range(n):
        if k:
            have = shift(apply(one, have[:-1]) ^ space, size[k:]) ^ words[k:]
        whole = doc[k:] == doc[: len(doc) - k]
        yield have[whole], doc[k:][whole]
        if len(have) < 2:
            return


def _features(batch: pa.RecordBatch, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For runs of documents: how many, words of each, and (bucket, document) of their features, one pair for each length of n-gram."""
    data, offsets = T.utf8(batch.column("text"))
    for i, j in T.runs(offsets):
        lo = offsets[i]
        part = T.LOWER[data[lo : offsets[j]]]
        starts, ends, doc = T.words(part, offsets[i : j + 1] - lo, T.ALNUM)
        crcs = word_crcs(part, starts, ends)
        found = [((c % U32(buckets)).astype(np.int64), d) for c, d in ngram_crcs(crcs, ends - starts, doc, n)]
        yield j - i, np.bincount(doc, minlength=j - i), found


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket; each task adds up its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in _features(batch, n, buckets):
                for b, _ in found:
                    total += np.bincount(b, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floored thousandths of the logarithm of the target's odds over the documents'; ``buckets`` numbers."""

    def dense(df: DataFrame, col: str) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, col, n, buckets).collect():
            out[r.bucket] = r.n
        return out

    s, t = dense(docs, text_col), dense(target, target_col)
    all_s, all_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = NGRAM) -> DataFrame:
    """Columns row, who, n_words, n_features, weight of the columns row, who, text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for many, n_words, found in _features(batch, n, len(gain)):
                count, total = np.zeros(many, np.int64), np.zeros(many)
                for b, d in found:
                    count += np.bincount(d, minlength=many)
                    total += np.bincount(d, gain[b].astype(np.float64), many)
                words.append(n_words), features.append(count)
                weights.append(np.where(count > 0, total.astype(np.int64) // np.maximum(count, 1), 0))
            own = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("who"), *own], ["row", "who", "n_words", "n_features", "weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("row", "who").schema)
    return docs.mapInArrow(score, f"{fields}, n_words bigint, n_features bigint, weight bigint")


def noise(who: Column, seed: int = SEED) -> Column:
    """Floored thousandths of Gumbel noise from the digest of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(who.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a range and adds the number of the range."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at + 1, at + n + 1)), pa.array(np.full(n, part, np.int32))], [*batch.schema.names, "place", "part"])
        at += n


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of a stored table with ``rank``: 1, 2, 3 ... of the drawn ones by falling score, then id; null for the others."""
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    most = percent * scored.where(able).count() // 100
    order = [able.desc(), F.col("score").desc(), F.col("who").asc_nulls_last(), F.col("rid").asc()]
    sorted_rows = scored.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    placed = stored(sorted_rows.mapInArrow(_numbered, f"{fields}, place bigint, part int"), "importance-placed")
    # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = placed.join(F.broadcast(ranges), "part").withColumn("rank", F.col("before") + F.col("place"))
    return joined.withColumn("rank", F.when(able & (F.col("rank") <= most), F.col("rank"))).drop("part", "place", "before", "rid")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: list[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Columns row (the document's columns, or those in ``keep``), n_words, n_features, weight, score, rank; one row per input row.

    ``row`` travels through the sort, so keep the id and join the text to the drawn rows where texts are large.
    """
    gain = gains(docs, target, text_col, target_col, n, buckets)
    plain = docs.select(F.struct(*[F.col(c) for c in keep or docs.columns]).alias("row"), F.col(id_col).alias("who"), F.col(text_col).cast("string").alias("text"))
    scored = weigh(plain, gain, n).withColumn("score", F.col("weight") + noise(F.col("who"), seed))
    return ranked(stored(scored, "importance-scored"), percent, least_words).drop("who")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH codes AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, i)) AS code),
texts AS (
  SELECT 0 AS side, rid, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM (SELECT row_number() OVER () AS rid, text FROM documents)
  UNION ALL SELECT 1, row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, rid, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (
  SELECT side, rid, unnest(words) AS feature FROM w
  UNION ALL SELECT side, rid, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) FROM w WHERE len(words) > 1),
g AS MATERIALIZED (SELECT side, rid, feature, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT feature, hex(encode(feature)) AS digits FROM (SELECT DISTINCT feature FROM g)),
b AS MATERIALIZED (
  SELECT feature, (xor(list_reduce(list_transform(range(len(digits) // 2), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::BIGINT),
    lambda c, d: xor(c >> 8, code[(xor(c, d) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS})::INT AS bucket
  FROM x, codes),
n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM g JOIN b USING (feature) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) + {BUCKETS} AS all_s, coalesce(sum(t), 0) + {BUCKETS} AS all_t FROM n),
v AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * all_s::DOUBLE / ((s + 1)::DOUBLE * all_t::DOUBLE)))::BIGINT AS gain FROM n, a),
m AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM g JOIN b USING (feature) JOIN v USING (bucket) WHERE side = 0 GROUP BY rid),
d AS (
  SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN m USING (rid) LEFT JOIN (SELECT rid, words FROM w WHERE side = 0) USING (rid)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS able FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END::BIGINT AS rank FROM r
"""
