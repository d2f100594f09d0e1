"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets. Sources in code point order (null last) weigh 3, 1, 2, repeating. They share ``share`` times
all words; no target may exceed ``most`` times its source's words. Resharing the excess by weight until
no target is above its limit ends at ``target = least(limit, rate * weight)`` for one rate, which follows
from prefix sums over the sources in order of limit / weight.

Certain copies. A source's documents are to appear ``target / source_size`` times; the whole part of that is a
number of certain copies of each document. What is then short of the target is sampled, in two rounds.

Round. Inclusion is in proportion to size over the whole source: ``p = rate * size``, at most 1, where ``rate`` is such that the expected words of the
sample are what is short. The documents of a source are put into classes of nearly equal size (eight to an octave), so that the sample has few words too many or
too few. From the largest class down, each gets a fixed number of places, ``n * p`` for the class's mean size, rounded up or down by a random
number of the class, within the limits that the smaller classes can make up for; what a class takes more or less moves the rate of those below it. A class with ``k`` places is a Pareto order
sample of that fixed size: with ``p = k * size / words of the class`` and a uniform
number ``u`` from a digest of the document's id, documents rank by ``(u / (1 - u)) / (p / (1 - p))`` and the least ``k`` enter; those
with ``p`` of at least 1 are certain. The first round aims at 15/16 of what is short, the second samples the
documents that are left for the rest, again in proportion to size.

Scale. The k-th rank of a class comes from a histogram of the ranks (``2**9`` bins for each class, counted before any
shuffle); only the documents of one bin per class are ever put in order. The table of sources, one row
each, is ordered in one task; a source's classes (at most 500) are planned in one row.

Defined results: a null or empty text has size 0 and is taken 0 times; a null doc_id draws by the digest of its text;
rows with the same id and text rank the same and enter together, so that repeated rows may exceed their
places; other ties of rank are broken by a hash of id and text. A source without words has target 0. Very long texts are counted whole and
are classes of their own. Empty tables give an empty result. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm._common import kept, small, stored, table

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 9
SEED = 17
#: What each round aims at, as a share of what is short when it begins.
AIMS = (0.9375, 1.0)


def n_words(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target of each source, from rows (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = by_source.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.expr(f"cast(place % {len(weights)} as int) + 1")))
    weighed = weighed.withColumn("most", F.lit(most).cast("bigint") * F.col("source_size"))
    ratio = F.col("most").cast("double") / F.col("weight")
    rising = Window.orderBy(ratio, "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before = weighed.select(
        "source", "source_size", "weight", "most",
        F.coalesce(F.sum("most").over(rising), F.lit(0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0))).alias("open_weight"),
        F.sum("source_size").over(everything).alias("all_words"),
    )
    rate = (F.lit(share) * F.col("all_words") - F.col("full")) / F.col("open_weight")
    fits = F.when(rate * F.col("weight") <= F.col("most"), rate)
    rated = before.withColumn("rate", F.max(fits).over(everything))
    return rated.select("source", "source_size", F.coalesce(F.least(F.col("most").cast("double"), F.col("rate") * F.col("weight")), F.col("most").cast("double")).alias("target"))


def uniform(text: Column) -> Column:
    """A number strictly between 0 and 1 from the MD5 digest of a string."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def size_class(size: str) -> Column:
    """Number of a size's class, rising: sizes under 8 by themselves, eight classes to each octave above."""
    return F.expr(f"cast(if({size} < 8, {size}, 8 * length(bin({size})) + (shiftright({size}, length(bin({size})) - 4) & 7)) as int)")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """(row, source, source_key, size, class, u, tie) of each document; ``row`` holds all its columns, or those in ``keep``."""
    source = F.col(source_col).cast("string")
    who = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    plain = docs.select(
        F.struct(*[F.col(c) for c in keep or docs.columns]).alias("row"),
        source.alias("source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("source_key"),
        n_words(F.col(text_col)).alias("size"),
        uniform(F.concat(F.lit(f"{seed}:"), who)).alias("u"),
        F.xxhash64(id_col, text_col).alias("tie"),
    )
    return plain.withColumn("class", size_class("size"))


def places(classes: DataFrame, short: DataFrame, name: str) -> DataFrame:
    """(source_key, class, n, words, take): the places of each class, from (source_key, class, n, words) and (source_key, short).

    ``name`` goes into the digest of the random roundings.
    """
    draw = uniform(F.concat(F.lit(f"{name}:"), "source_key", F.lit(":"), F.col("class").cast("string")))
    upto = Window.partitionBy("source_key").orderBy("class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the words that this class and the smaller ones would give at a rate of 1
    square = F.sum(F.col("words").cast("double") * F.col("words").cast("double") / F.col("n").cast("double")).over(upto)
    ranked = classes.withColumn("square", square)
    listed = ranked.groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("class", "n", "words", draw.alias("draw"), "square")), asc=False).alias("classes"), F.sum("words").alias("rest"))
    kind = "array<struct<class:int,n:bigint,words:bigint,take:bigint>>"
    start = F.struct(F.col("short").cast("double").alias("short"), F.col("rest"), F.array().cast(kind).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        short, n, words = acc["short"], c["n"].cast("double"), c["words"].cast("double")
        smaller = acc["rest"] - c["words"]
        mean = words / n
        least, most = F.ceil((short - smaller) / mean).cast("double"), F.floor(short / mean).cast("double")
        want = F.floor(n * F.least(F.lit(1.0), short * mean / c["square"]) + c["draw"]).cast("double")
        closer = F.when((short - smaller) / mean - most <= least - short / mean, most).otherwise(least)
        take = F.when(least <= most, F.least(F.greatest(want, least), most)).otherwise(closer)
        take = F.least(F.greatest(take, F.lit(0.0)), n)
        taken = F.struct(c["class"].alias("class"), c["n"].alias("n"), c["words"].alias("words"), take.cast("bigint").alias("take"))
        return F.struct((short - take * mean).alias("short"), smaller.alias("rest"), F.concat(acc["out"], F.array(taken)).alias("out"))

    joined = listed.join(short, "source_key")
    return joined.select("source_key", F.inline(F.aggregate("classes", start, step, lambda acc: acc["out"])))


def rank(take: Column, size: Column, words: Column, u: Column) -> Column:
    """The Pareto rank: odds of the uniform number over odds of inclusion; 0 if inclusion is certain, null if it is impossible."""
    p = take.cast("double") * size.cast("double") / words.cast("double")
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(small(other)(other), keys, how)


def sample(rows: DataFrame, short: DataFrame, name: str) -> DataFrame:
    """Stored (source_key, class, words, take, n, cut_rank, cut_tie): a document of the class enters up to that rank and tie.

    ``rows`` (source_key, class, size, u, tie) is read three times. Classes whose documents all enter, or none, have no cut.
    """
    rows = rows.where("size > 0")
    classes = rows.groupBy("source_key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("words"))
    plan = stored(places(classes, short, name), "mix-places")
    part = _joined(rows, plan.where("take > 0 and take < n"), ["source_key", "class"])
    part = part.withColumn("rank", rank(F.col("take"), F.col("size"), F.col("words"), F.col("u")))
    # The rank by the class's mean odds, brought to 0..1, is nearly uniform.
    even = F.col("rank") * (F.col("take") / (F.col("n") - F.col("take")))
    part = part.withColumn("bin", F.least(F.floor(even / (1 + even) * BINS), F.lit(BINS - 1)).cast("int"))
    upto = Window.partitionBy("source_key", "class").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = part.groupBy("source_key", "class", "bin", "take").agg(F.count(F.lit(1)).alias("in_bin")).withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0)))
    edge = stored(bins.where("before < take and before + in_bin >= take").select("source_key", "class", "bin", "before"), "mix-edge")
    inside = _joined(part, edge, ["source_key", "class", "bin"]).groupBy("source_key", "class", "rank", "tie", "before", "take").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("source_key", "class").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("total", F.col("before") + F.sum("k").over(order)).where("total >= take")
    cut = reached.groupBy("source_key", "class").agg(F.min(F.struct("rank", "tie")).alias("cut"))
    return stored(plan.join(cut, ["source_key", "class"], "left").select("source_key", "class", "words", "take", "n", F.col("cut.rank").alias("cut_rank"), F.col("cut.tie").alias("cut_tie")), "mix-cuts")


def entered(rows: DataFrame, cuts: DataFrame, flag: str) -> DataFrame:
    """Rows with ``flag``: whether the document is in the sample."""
    columns = rows.columns
    joined = _joined(rows, cuts.select("source_key", "class", F.struct("words", "take", "n", "cut_rank", "cut_tie").alias("cut")), ["source_key", "class"], "left")
    own = rank(F.col("cut.take"), F.col("size"), F.col("cut.words"), F.col("u"))
    within = (own < F.col("cut.cut_rank")) | ((own == F.col("cut.cut_rank")) & (F.col("tie") <= F.col("cut.cut_tie")))
    inside = (F.col("size") > 0) & (F.col("cut.take") > 0) & ((F.col("cut.take") == F.col("cut.n")) | within)
    return joined.select(*columns, F.coalesce(inside, F.lit(False)).alias(flag))


def plan_mix(sizes: DataFrame, seed: int = SEED, **options) -> tuple[DataFrame, list[DataFrame]]:
    """Targets (source_key, source_size, target, copies, short) of the sources, and the cuts of each round.

    ``sizes`` has (source, source_key, class, size, u, tie) and is read several times, so it should be kept.
    """
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("size")), **options)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("copies", F.floor(times).cast("bigint"))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    targets = targets.select(key.alias("source_key"), "source_size", "target", "copies", (F.round("target").cast("bigint") - F.col("copies") * F.col("source_size")).alias("short"))
    targets = stored(targets, "mix-targets")
    left, short, rounds = sizes, targets.select("source_key", "short"), []
    for k, aim in enumerate(AIMS):
        rounds.append(sample(left, short.withColumn("short", F.floor(F.col("short") * F.lit(aim))), f"{seed}:{k}"))
        if k + 1 < len(AIMS):
            marked = entered(left, rounds[-1], "inside")
            got = marked.where("inside").groupBy("source_key").agg(F.sum("size").alias("got"))
            short = stored(short.join(got, "source_key", "left").select("source_key", F.greatest(F.col("short") - F.coalesce("got", F.lit(0)), F.lit(0)).alias("short")), "mix-short")
            left = marked.where("not inside").drop("inside")
    return targets, rounds


def apply_mix(rows: DataFrame, targets: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Columns row, size, source_size, target, taken of measured rows."""
    # A document in the sample of a round is no part of the next one.
    once, out = F.lit(False), rows
    for k, cuts in enumerate(rounds):
        out = entered(out, cuts, f"inside{k}")
        once = once | F.col(f"inside{k}")
    joined = _joined(out, targets, ["source_key"])
    return joined.select("row", "size", "source_size", "target", (F.col("size") * (F.col("copies") + once.cast("bigint"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """Columns row (all columns of the document), size, source_size, target, taken; one row per input row."""
    rows = measured(docs, id_col, text_col, source_col, seed)
    sizes = kept(rows.drop("row"))
    return apply_mix(rows, *plan_mix(sizes, seed, **options))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(measured(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return apply_mix(rows, *plan_mix(rows.drop("row"))).select("row.doc_id", "size", "source_size", "target", "taken")


def _round_sql(k: int, aim: float, rows: str, short: str) -> str:
    """CTEs of round ``k``: places by recursion over the classes of ``rows``, Pareto ranks, and ``inside{k}``, the rows with a flag."""
    return f"""
k{k} AS (SELECT key, cls, count(*)::DOUBLE AS n, sum(size)::DOUBLE AS words, row_number() OVER (PARTITION BY key ORDER BY cls DESC) AS place,
    coalesce(sum(sum(size)) OVER (PARTITION BY key ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS smaller,
    sum(sum(size)::DOUBLE * sum(size)::DOUBLE / count(*)::DOUBLE) OVER (PARTITION BY key ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS square,
    (('0x' || substr(md5('{SEED}:{k}:' || key || ':' || cls), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS draw
  FROM {rows} WHERE size > 0 GROUP BY key, cls),
fold{k}(key, place, left_over, cls, take) AS (
  SELECT key, 0, floor(short * {aim}::DOUBLE)::DOUBLE, NULL::INT, 0::DOUBLE FROM {short}
  UNION ALL
  SELECT key, place, left_over - take * mean, cls, take FROM (
    SELECT key, place, left_over, mean, cls, least(greatest(
      CASE WHEN lo <= hi THEN least(greatest(want, lo), hi) WHEN (left_over - smaller) / mean - hi <= lo - left_over / mean THEN hi ELSE lo END, 0), n) AS take
    FROM (SELECT f.key, c.place, f.left_over, c.cls, c.n, c.smaller, c.words / c.n AS mean, ceil((f.left_over - c.smaller) / (c.words / c.n)) AS lo, floor(f.left_over / (c.words / c.n)) AS hi,
        floor(c.n * least(1::DOUBLE, f.left_over * (c.words / c.n) / c.square) + c.draw) AS want
      FROM fold{k} f JOIN k{k} c ON c.key = f.key AND c.place = f.place + 1))),
ranked{k} AS (
  SELECT *, row_number() OVER (PARTITION BY key, cls ORDER BY rank, doc_id) AS standing FROM (
    SELECT r.*, take, n, CASE WHEN take = 0 THEN NULL WHEN take * r.size::DOUBLE / words >= 1 THEN 0 ELSE (u / (1 - u)) / ((take * r.size::DOUBLE / words) / (1 - (take * r.size::DOUBLE / words))) END AS rank
    FROM {rows} r LEFT JOIN fold{k} f ON f.key = r.key AND f.cls = r.cls AND r.size > 0 LEFT JOIN k{k} c ON c.key = r.key AND c.cls = r.cls)),
inside{k} AS MATERIALIZED (SELECT * EXCLUDE (take, n, rank, standing), coalesce(take > 0 AND (take = n OR rank <= max(rank) FILTER (standing <= take) OVER (PARTITION BY key, cls)), FALSE) AS inside{k} FROM ranked{k}),
short{k + 1} AS MATERIALIZED (SELECT s.key, greatest(s.short - coalesce(sum(i.size) FILTER (i.inside{k}), 0), 0)::BIGINT AS short FROM {short} s LEFT JOIN inside{k} i ON i.key = s.key GROUP BY s.key, s.short)"""


OP9_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, CASE WHEN size < 8 THEN size ELSE 8 * length(bin(size)) + ((size >> (length(bin(size)) - 4)) & 7) END::INT AS cls FROM (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
    FROM documents)),
s AS (
  SELECT source, key, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source, key),
r AS (
  SELECT *, 2 * source_size AS most,
    coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS full_words,
    (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS open_weight, (sum(source_size) OVER ())::DOUBLE AS all_words
  FROM s WINDOW w AS (ORDER BY (2 * source_size)::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (1.5::DOUBLE * all_words - full_words) / open_weight AS rate FROM r),
f AS (SELECT *, max(CASE WHEN rate * weight <= most THEN rate END) OVER () AS fit FROM q),
t AS (SELECT key, source_size, coalesce(least(most::DOUBLE, fit * weight), most::DOUBLE) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
short0 AS MATERIALIZED (SELECT *, round(target)::BIGINT - copies * source_size AS short FROM p),
{_round_sql(0, AIMS[0], "d", "short0")},
left1 AS MATERIALIZED (SELECT * FROM inside0 WHERE NOT inside0),
{_round_sql(1, AIMS[1], "left1", "short1")}
SELECT i.doc_id, i.size, z.source_size, z.target, (i.size * (copies + (inside0 OR coalesce(inside1, FALSE))::BIGINT))::BIGINT AS taken
FROM (SELECT doc_id, key, size, inside0, FALSE AS inside1 FROM inside0 WHERE inside0 UNION ALL SELECT doc_id, key, size, inside0, inside1 FROM inside1) i JOIN short0 z ON z.key = i.key
"""
