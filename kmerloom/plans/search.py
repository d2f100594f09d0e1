"""Queries over encoded windows, classification, propagation and the read-level search, each with SQL of its own.

The benchmark items are a small library: an item's lineage is as deep as its id says, so that nodes of all ranks hold sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import encode, harness, identify, propagate, similarity
from kmerloom.operators.induct import induct_pairs
from kmerloom.plans.catalog import REVCOMP_SQL, WHOLE_SQL, _gram_sql, query, spread, table, whole_dna

_RANKS = ("p__", "c__", "o__", "f__", "g__", "s__")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", whole_dna(F.coalesce("text", F.lit(""))).alias("sequence"))


_ITEMS = f"(SELECT item_id, {WHOLE_SQL} AS s FROM benchmark)"
_IDS = f"CASE WHEN regexp_full_match(x, '[ACGT]{{5}}') THEN least(x, {REVCOMP_SQL.format('x')}) END"


def _window_sql(offset: int, per: int, incremental: bool = False) -> str:
    """CTEs: items ``it``, windows ``w`` (item_id, t, i: positions of k-mers), counts ``wc`` (item_id, t, kmer, n) and ``wn`` (item_id, t, norm2).

    Of windows after the first, the incremental update leaves the k-mer at place 120 of the sequence in the last place.
    """
    at = "CASE WHEN t > 0 AND j = 120 THEN 120 ELSE t + j END" if incremental else "t + j"
    whole = f"UNION ALL SELECT item_id, s, 0, length(s) - 4 FROM it WHERE length(s) BETWEEN 1 AND 125" if offset == 126 else ""
    return f"""
it AS MATERIALIZED (SELECT item_id, s FROM {_ITEMS}),
w AS (SELECT item_id, s, unnest(range(0, length(s) - {offset - 1}, 10)) AS t, {per}::BIGINT AS m FROM it {whole}),
wk AS (SELECT item_id, t, substr(s, ({at} + 1)::BIGINT, 5) AS x FROM (SELECT item_id, s, t, unnest(range(0, greatest(m, 0))) AS j FROM w)),
wc AS MATERIALIZED (SELECT item_id, t, {_IDS} AS kmer, count(*) AS n FROM wk WHERE regexp_full_match(x, '[ACGT]{{5}}') GROUP BY ALL),
wn AS MATERIALIZED (SELECT w.item_id, w.t, coalesce(any_value(q.norm2), 0)::BIGINT AS norm2 FROM w LEFT JOIN (
  SELECT x.item_id, x.t, sum(x.n * y.n * dot) AS norm2 FROM wc x JOIN wc y USING (item_id, t) JOIN g ON a = x.kmer AND b = y.kmer GROUP BY ALL) q USING (item_id, t) GROUP BY ALL)"""


def _window_query(rule: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = encode.encode_windows(_items(spark, sf_dir), rule=rule, mode=mode)
        return found.select("item_id", F.col("window_start").cast("bigint").alias("window_start"), "norm2")

    return run


for _name, _rule, _mode, _sql in (
    ("item_windows_cpu", "cpu", "direct", _window_sql(126, 121)),
    ("item_windows_gpu", "gpu", "direct", _window_sql(125, 120)),
    ("item_windows_incremental", "cpu", "incremental", _window_sql(126, 121, True)),
):
    _run = _window_query(_rule, _mode)
    _run.__name__ = _name
    query(f"WITH {_gram_sql()}, {_sql} SELECT item_id, t AS window_start, norm2 FROM wn")(_run)


@query(f"WITH {_gram_sql()}, {_window_sql(126, 121)} SELECT item_id, t AS window_start, kmer, n FROM wc WHERE item_id IN (SELECT item_id FROM it WHERE length(s) > 125)")
def item_window_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each k-mer in each window, by the sliding sum."""
    found = encode.window_kmer_counts(_items(spark, sf_dir), "item_id")
    return found.select("item_id", F.col("window_start").cast("bigint").alias("window_start"), "kmer", "n")


#: Whole sequences ``sc`` (item_id, kmer, n), projections ``sp`` and lengths ``sn``; scores ``ws`` of all items against all windows.
_SCORES = f"""
sk AS (SELECT item_id, substr(s, i::BIGINT, 5) AS x FROM (SELECT item_id, s, unnest(range(1, length(s) - 3)) AS i FROM it WHERE length(s) >= 5)),
sc AS MATERIALIZED (SELECT item_id, {_IDS} AS kmer, count(*) AS n FROM sk WHERE regexp_full_match(x, '[ACGT]{{5}}') GROUP BY ALL),
sp AS MATERIALIZED (SELECT item_id, b AS kmer, sum(n * dot) AS v FROM sc JOIN g ON a = kmer GROUP BY ALL),
sn AS MATERIALIZED (SELECT item_id, sum(n * v)::DOUBLE AS norm2 FROM sc JOIN sp USING (item_id, kmer) GROUP BY ALL),
wd AS (SELECT sp.item_id AS q, wc.item_id AS r, t, sum(wc.n * v)::DOUBLE AS dot FROM sp JOIN wc USING (kmer) GROUP BY ALL),
ws AS MATERIALIZED (SELECT q.item_id AS q, wn.item_id AS r, wn.t, CASE WHEN q.norm2 > 0 AND wn.norm2 > 0 THEN 2 * (coalesce(dot, 0) / (sqrt(q.norm2) * sqrt(wn.norm2::DOUBLE)) - 0.5) ELSE -1 END AS score
  FROM (SELECT item_id, coalesce(norm2, 0) AS norm2 FROM it LEFT JOIN sn USING (item_id)) q CROSS JOIN wn LEFT JOIN wd ON wd.q = q.item_id AND wd.r = wn.item_id AND wd.t = wn.t)"""


@query(f"""
WITH {_gram_sql()}, {_window_sql(126, 121)}, {_SCORES},
best AS (SELECT q, r, max(score) AS score, arg_max(t, (score, -t)) AS pos FROM ws GROUP BY q, r)
SELECT q AS query_id, r AS ref_id, round(CASE WHEN length(s) <= 125 THEN score ELSE greatest(score, -1) END, 6) AS score, CASE WHEN score > -1 THEN pos ELSE 0 END::BIGINT AS pos FROM best JOIN it ON it.item_id = r
""")
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each item for each item."""
    items = _items(spark, sf_dir).where("sequence <> ''")
    asked = encode.encode_sequences(items).select(F.col("item_id").alias("query_id"), F.col("ids").alias("query_ids"))
    found = similarity.best_windows(asked, items.select(F.col("item_id").alias("ref_id"), "sequence"))
    return found.select("query_id", "ref_id", F.round("score", 6).alias("score"), "pos")


def _lineage():
    """An item's lineage: one to six ranks below the root, by its id."""
    i = F.col("item_id")
    labels = [F.concat(F.lit(f"; {rank}{rank[0]}"), (i % m).cast("string")) for rank, m in zip(_RANKS, (2, 4, 4, 8, 8, 16))]
    depth = i % 6 + 1
    return F.concat(F.lit("k__Items"), *[F.when(depth > k, x).otherwise("") for k, x in enumerate(labels)])


_LINEAGE = "'k__Items' || " + " || ".join(f"CASE WHEN item_id % 6 + 1 > {k} THEN '; {rank}{rank[0]}' || (item_id % {m}) ELSE '' END" for k, (rank, m) in enumerate(zip(_RANKS, (2, 4, 4, 8, 8, 16))))
#: Library ``lib`` (category, item_id), edges ``ed`` (parent, child), and whole-sequence scores.
_TREE = f"""
lin AS MATERIALIZED (SELECT item_id, string_split({_LINEAGE}, '; ') AS t FROM benchmark),
lib AS MATERIALIZED (SELECT t[-1] AS category, item_id FROM lin JOIN it USING (item_id) WHERE s <> ''),
ed AS MATERIALIZED (SELECT DISTINCT t[i] AS parent, t[i + 1] AS child FROM (SELECT t, unnest(range(1, len(t))) AS i FROM lin))"""


def _induced(spark: SparkSession, sf_dir: str):
    rows = _items(spark, sf_dir).select(F.col("item_id").cast("string").alias("seq_id"), "sequence", _lineage().alias("lineage"))
    return induct_pairs(rows.select("seq_id", "sequence"), rows.select("seq_id", "lineage"))


def _beam_sql(levels: int = 6, beam: int = 5) -> str:
    """Six levels of the walk, written out: candidates, their best windows, the best five, those at least 0 alive."""
    out = ["a0 AS (SELECT item_id AS q, []::VARCHAR[] AS path, []::DOUBLE[] AS scores, -1::DOUBLE AS score FROM it WHERE s <> '')", "roots AS (SELECT DISTINCT parent AS child FROM ed WHERE starts_with(parent, 'p__'))"]
    for k in range(levels):
        grow = f"SELECT q, path, scores, child FROM a{k}, roots" if k == 0 else f"SELECT q, path, scores, coalesce(ed.child, path[-1]) AS child FROM a{k} LEFT JOIN ed ON ed.parent = path[-1]"
        out.append(f"c{k} AS MATERIALIZED (SELECT c.q, list_append(path, c.child) AS path, list_append(scores, coalesce(best, -1)) AS scores, coalesce(best, -1) AS score FROM ({grow}) c LEFT JOIN node_best n ON n.q = c.q AND n.category = c.child)")
        out.append(f"r{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, path) AS place FROM c{k} QUALIFY place <= {beam})")
        out.append(f"a{k + 1} AS (SELECT q, path, scores, score FROM r{k} WHERE score >= 0)")
    return ", ".join(out)


_LOST = " UNION ALL ".join(f"SELECT q, path, scores FROM r{k} WHERE place = 1 AND score < 0" for k in range(6))


@query(f"""
WITH {_gram_sql()}, {_window_sql(126, 121)}, {_SCORES}, {_TREE},
node_best AS MATERIALIZED (SELECT q, category, greatest(max(score), -1) AS best FROM ws JOIN lib ON lib.item_id = ws.r GROUP BY q, category),
{_beam_sql()},
done AS (SELECT q, path, scores, 'COMPLETE' AS status FROM r5 WHERE place = 1 AND score >= 0 UNION ALL SELECT q, path, scores, 'EARLY_EXIT' FROM ({_LOST})),
names AS (SELECT min(item_id) AS q, arg_min(item_id, item_id)::VARCHAR AS name FROM it WHERE s <> '' GROUP BY s)
SELECT q AS query_id, name, array_to_string(path, ';') AS path, array_to_string(list_transform(scores, lambda x: format('{{:.4f}}', x)), ';') AS path_scores, status FROM done JOIN names USING (q)
""")
def identify_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items walk the taxonomy of the items themselves."""
    found = _induced(spark, sf_dir)
    asked = _items(spark, sf_dir).select(F.col("item_id").cast("string").alias("name"), "sequence", F.col("item_id").alias("ord"))
    out = identify.identify(asked, found.sequences, found.index)
    scores = F.array_join(F.transform("path_scores", lambda x: F.format_string("%.4f", x)), ";")
    return out.select("query_id", "name", F.array_join("path", ";").alias("path"), scores.alias("path_scores"), "status")


#: Greedy propagation: descendants of each parent in order, each compared with what the parent holds by then.
_GREEDY = f"""
pairs AS MATERIALIZED (SELECT x.item_id AS i, y.item_id AS j, CASE WHEN nx.norm2 > 0 AND ny.norm2 > 0 THEN 2 * (coalesce(d.dot, 0) / (sqrt(nx.norm2) * sqrt(ny.norm2)) - 0.5) ELSE -1 END AS score
  FROM lib x CROSS JOIN lib y LEFT JOIN sn nx ON nx.item_id = x.item_id LEFT JOIN sn ny ON ny.item_id = y.item_id
  LEFT JOIN (SELECT sp.item_id AS i, sc.item_id AS j, sum(n * v)::DOUBLE AS dot FROM sp JOIN sc USING (kmer) GROUP BY ALL) d ON d.i = x.item_id AND d.j = y.item_id),
maps AS MATERIALIZED (SELECT i, map(list(j), list(score)) AS m FROM pairs GROUP BY i),
down(ancestor, node, way) AS (SELECT parent, child, chr(1) || child FROM ed UNION ALL SELECT ancestor, child, way || chr(1) || child FROM down JOIN ed ON parent = node),
todo AS MATERIALIZED (SELECT ancestor AS parent, item_id, row_number() OVER (PARTITION BY ancestor ORDER BY way, item_id::VARCHAR) AS place FROM down JOIN lib ON category = node WHERE NOT starts_with(ancestor, 'k__')),
own AS (SELECT parent, list(item_id) AS held FROM (SELECT DISTINCT parent FROM todo) LEFT JOIN lib ON category = parent GROUP BY parent),
walk(parent, place, held, item_id, best, added) AS (
  SELECT parent, 0, list_filter(held, lambda x: x IS NOT NULL), NULL::BIGINT, NULL::DOUBLE, FALSE FROM own
  UNION ALL
  SELECT parent, place, CASE WHEN best < 0.75 THEN list_append(held, item_id) ELSE held END, item_id, best, best < 0.75 FROM (
    SELECT w.parent, t.place, w.held, t.item_id, greatest(0, coalesce(list_max(list_transform(w.held, lambda x: maps.m[x])), 0)) AS best
    FROM walk w JOIN todo t ON t.parent = w.parent AND t.place = w.place + 1 JOIN maps ON maps.i = t.item_id))"""


@query(f"""
WITH RECURSIVE {_gram_sql()}, {_window_sql(126, 121)}, {_SCORES}, {_TREE}, {_GREEDY}
SELECT parent, item_id::VARCHAR AS seq_id, round(best, 6) AS best_score, added FROM walk WHERE place > 0
""")
def propagate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each descendant's best score against what its ancestor holds, and whether it is added."""
    found = _induced(spark, sf_dir)
    scored = propagate.score_descendants(found.sequences, found.index)
    return scored.select("parent", "seq_id", F.round("best_score", 6).alias("best_score"), "added")


@query(f"""
WITH RECURSIVE {_gram_sql()}, {_window_sql(126, 121)}, {_SCORES}, {_TREE}, {_GREEDY}
SELECT b AS bucket, count(item_id)::BIGINT AS n, (SELECT count(*) FROM walk WHERE added)::BIGINT AS total_added
FROM range(101) r(b) LEFT JOIN walk ON place > 0 AND least(floor(best * 100), 100) = b GROUP BY b
""")
def propagate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buckets of the histogram and the total."""
    found = _induced(spark, sf_dir)
    return propagate.report(propagate.score_descendants(found.sequences, found.index))


@query(f"""
WITH {_gram_sql()}, {_window_sql(125, 120)},
half AS (SELECT item_id, row_number() OVER (ORDER BY item_id) <= (SELECT count(*) // 2 FROM it) AS first FROM it),
q AS (SELECT wn.* FROM wn JOIN half USING (item_id) WHERE first AND t = 0 AND norm2 > 0),
qp AS (SELECT item_id, b AS kmer, sum(n * dot) AS v FROM wc JOIN g ON a = kmer WHERE t = 0 AND item_id IN (SELECT item_id FROM q) GROUP BY ALL),
d AS (SELECT qp.item_id AS q, wc.item_id AS r, wc.t, sum(wc.n * v)::DOUBLE AS dot FROM qp JOIN wc USING (kmer) JOIN half ON half.item_id = wc.item_id AND NOT first GROUP BY ALL),
s AS (SELECT q.item_id AS q, w.item_id AS r, w.t, coalesce(dot, 0) / (sqrt(q.norm2::DOUBLE) * sqrt(w.norm2::DOUBLE)) AS cosine
  FROM q CROSS JOIN (SELECT wn.* FROM wn JOIN half USING (item_id) WHERE NOT first AND norm2 > 0) w LEFT JOIN d ON d.q = q.item_id AND d.r = w.item_id AND d.t = w.t)
SELECT q AS read_id, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, r, t) AS rank, r AS db_read, t AS window_start, round(cosine, 6) AS cosine FROM s QUALIFY rank <= 5
""")
def read_search_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First windows of the first half of the items against all windows of the second half, with the reads they come from."""
    reads = _items(spark, sf_dir).withColumnRenamed("item_id", "read_id")
    return harness.read_search(reads).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_gram_sql()}, {_window_sql(125, 120)} SELECT count(*) AS n, count(*) AS n_agree FROM wn WHERE t = 0 AND norm2 > 0 AND item_id IN (SELECT item_id FROM it ORDER BY item_id LIMIT (SELECT count(*) // 2 FROM it))")
def read_search_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search against scores that built-in functions compute pair by pair from the k-mers' vectors."""
    reads = _items(spark, sf_dir).withColumnRenamed("item_id", "read_id")
    first, second = harness.halves(reads)
    truth = similarity.native_window_scores(encode.encode_windows(first, rule="gpu").where("window_start = 0"), encode.encode_windows(second, rule="gpu"))
    return harness.read_agreement(harness.read_search(reads), truth)
