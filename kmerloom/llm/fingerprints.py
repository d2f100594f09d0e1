"""Document fingerprints: SimHash with a Hamming search by permuted block tables (DataFrame functions only).

*Votes.* The terms of a text are its pairs of successive words (the last word pairs with nothing). Each
occurrence of a term votes on 64 bits with the term's hash, weighted by the length of its first word (8 at most).
Votes for bit j and bit j + 32 are summed in the two halves of one long, so 32 sums hold all;
they are added up where the text is read, and one row per text is shuffled. A bit is set if more than half of
the weight votes for it. A text without words has fingerprint 0.

*Next document.* Documents are dealt into ranges of doc_id (splitters are quantiles of doc_id); the
first document of each range is sent to the range before as well, so that ``lead`` within a range sees the true
next document and no task orders all rows.

*Search.* ``within_radius`` cuts fingerprints into ``radius + k`` blocks. Two of them within the radius agree in
``k`` blocks at least; for each choice of ``k`` blocks a table holds the fingerprints permuted so that these blocks
stand first, and equal leading blocks are joined. A pair counts in its first such table only. ``k`` grows with the number of fingerprints, so
that the leading blocks have about as many bits as tell that many apart, and unrelated candidates stay few.

Defined results: null texts are empty; ties of doc_id are ordered by a hash of the text; a null doc_id comes
first; a single document is its own next one. Repeated rows are fingerprinted each. Texts of any length are read whole: their words become
rows, summed where they are read. Other columns are never looked at. Empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm._common import kept, partitions, stored, table

HALVES = (1 << 32) + 1
RADIUS = 3
QUERY_EVERY = 20


def _votes(h: Column, weight: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(HALVES)) * weight).alias(f"v{j}") for j in range(32)]


def _bits() -> Column:
    """The fingerprint as a long, from v0 ... v31 and weight."""
    out = F.lit(0).cast("bigint")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for bit, votes in ((j, low), (j + 32, high)):
            out = out.bitwiseOR(F.when(2 * votes > F.col("weight"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def simhash(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(*keys, fingerprint bigint) of each text; the keys must tell the rows apart."""
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    listed = texts.select(*keys, words.alias("words"))
    terms = listed.select(*keys, F.inline_outer(F.arrays_zip(F.col("words").alias("w"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))).alias("w", "next"))
    weight = F.when(F.col("w").isNull(), 0).otherwise(F.least(F.length("w"), F.lit(8))).cast("bigint")
    hashed = terms.select(*keys, F.xxhash64("w", "next").alias("h"), weight.alias("k"))
    return hashed.groupBy(*keys).agg(F.sum("k").alias("weight"), *_votes(F.col("h"), F.col("k"))).select(*keys, _bits().alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, text) with next_rid and next_text of the next document in order of doc_id, the last one's being the first."""
    spark = docs.sparkSession
    n = max(partitions(spark), spark.sparkContext.defaultParallelism)
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")))
    found = keyed.agg(F.min("key"), F.percentile_approx("key", [k / n for k in range(1, n)], 100 * n)).first()
    if found[0] is None:
        return docs.select("rid", "doc_id", "text", F.col("rid").alias("next_rid"), F.col("text").alias("next_text"))
    splits = sorted(set(found[1]) - {found[0]})
    bounds = F.array(*[F.lit(s).cast("bigint") for s in [found[0], *splits]])
    # A key's bucket is the last bound that is at most the key, by binary search; a bucket's first key is itself a bound.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))] or [F.lit(1)])

    def search(at: Column, step: Column) -> Column:
        return F.when(F.get(bounds, at + step) <= F.col("key"), at + step).otherwise(at)

    bucket = F.aggregate(steps, F.lit(0), search)
    own = keyed.withColumn("bucket", bucket)
    ghost = F.get(bounds, F.col("bucket")) == F.col("key")
    before = F.pmod(F.col("bucket") - 1, F.lit(len(splits) + 1))
    sent = F.when(ghost, F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("turn")), F.struct(before.alias("at"), F.lit(1).alias("turn")))).otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("turn"))))
    # ``turn`` puts the first of the following range (for the last range: the first of all) behind all others
    dealt = own.select("rid", "doc_id", "key", "text", F.inline(sent)).repartitionById(len(splits) + 1, F.col("at"))
    order = Window.partitionBy("at").orderBy("turn", "key", F.xxhash64("text"), "rid")
    led = dealt.select("rid", "doc_id", "text", "turn", F.lead("rid").over(order).alias("next_rid"), F.lead("text").over(order).alias("next_text"))
    return led.where("turn = 0").drop("turn")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of the next document."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def leading_blocks(n: int, radius: int = RADIUS) -> int:
    """Blocks that must agree so that about log2(n) - 2 bits lead, at least 2 (64 bits in ``radius`` more blocks than that)."""
    need = max(0.0, math.log2(max(1, n)) - 2)
    return next((k for k in range(2, 9) if 64 * k / (radius + k) >= need), 8)


def within_radius(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, leading: int = 2) -> DataFrame:
    """(q, f, ...) all fingerprints f of ``rows`` within ``radius`` bits of each fingerprint q of ``queries`` (distinct columns of longs), with the other columns of ``rows``."""
    blocks = radius + leading
    edges = [64 * k // blocks for k in range(blocks + 1)]
    mask = lambda k: ((1 << (edges[k + 1] - edges[k])) - 1) << edges[k]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")
    chosen = [sum(mask(b) for b in own) for own in combinations(range(blocks), leading)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(signed(m)).alias("k")) for i, m in enumerate(chosen)]
        return df.select("*", F.inline(F.array(*keys)))

    x, y = tables(queries, "q").alias("x"), tables(rows, "f").alias("y")
    differ = F.col("q").bitwiseXOR(F.col("f"))
    first = F.lit(len(chosen))
    for i, m in reversed(list(enumerate(chosen))):
        first = F.when(differ.bitwiseAND(signed(m)) == 0, F.lit(i)).otherwise(first)
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (hamming(F.col("q"), F.col("f")) <= radius) & (first == F.col("x.t"))
    return x.join(y.hint("merge"), on).select("q", *rows.columns)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near, for rows whose doc_id is divisible by 20 (else null): the documents, itself included, with a
    fingerprint within 3 bits of the row's.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
    led = with_next(rows).select("rid", "next_rid", "doc_id", "text", edited(F.col("text"), F.col("next_text")).alias("new"))
    kinds = F.array(F.struct(F.lit(False).alias("is_new"), F.col("text").alias("body"), F.length("text").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(True).alias("is_new"), F.col("new").alias("body"), F.lit(None).cast("bigint").alias("n_chars"), F.sha2(F.col("new").cast("binary"), 256).alias("sha")))
    bodies = led.select("rid", "next_rid", "doc_id", F.inline(kinds))
    prints = simhash(bodies, "body", "rid", "next_rid", "doc_id", "is_new", "n_chars", "sha")
    per_row = prints.groupBy("rid", "next_rid", "doc_id").agg(F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"), F.max(F.when(~F.col("is_new"), F.col("fingerprint"))).alias("f"), F.max(F.when(F.col("is_new"), F.col("fingerprint"))).alias("e"))
    per_row = kept(per_row)
    after = per_row.select(F.col("rid").alias("id2"), F.col("f").alias("next_f"))
    same = kept(per_row.groupBy("f").agg(F.count(F.lit(1)).alias("copies")))
    asked = per_row.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("f").alias("q")).distinct()
    near = within_radius(asked, same, leading=leading_blocks(same.count())).groupBy("q").agg(F.sum("copies").alias("n_near"))
    near = stored(near, "fingerprints-near")
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    joined = per_row.join(after, F.col("next_rid") == F.col("id2"), "left")
    # only the asking rows meet the search's results: the others would all share one key
    told = joined.where(asks).join(near, F.col("f") == F.col("q"), "left").drop("q")
    joined = told.unionByName(joined.where(~asks).withColumn("n_near", F.lit(None).cast("bigint")))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    like = lambda a, b: 1 - hamming(a, b) / 64.0
    return joined.select("doc_id", "n_chars", "edited_sha256", text(F.col("f")).alias("fingerprint"), text(F.col("e")).alias("edited_fingerprint"), like(F.col("f"), F.col("e")).alias("near_edited"), like(F.col("f"), F.col("next_f")).alias("near_next"), "n_near")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
