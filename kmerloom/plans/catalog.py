"""The registered queries of the engine and the SQL that gives the same rows.

The tables hold no DNA; a deterministic recipe turns letters of ``documents`` and ``benchmark`` texts into bases, in
both engines alike: ASCII letters are mapped to ACGT by their place in the alphabet, all else is '.', an unknown base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions import dna, hv, lineage
from kmerloom.operators import align, encode, identify, propagate, sample, similarity, taxonomy
from kmerloom.operators.induct import induct_pairs
from kmerloom.session import lean_batches, spread, stored

FLAGSHIP = "emb_cosine_topk_k10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_dna(text):
    """The whole text as DNA."""
    return dna.text_to_dna(text, 1 << 30)


WHOLE_SQL = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '.', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
REVCOMP_SQL = "reverse(translate(regexp_replace({0}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


def documents_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", whole_dna(F.coalesce("text", F.lit(""))).alias("sequence"))


def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sequences with a lineage of region, nation and market segment."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("k__World; p__"), "r_name", F.lit("; c__"), "n_name", F.lit("; o__"), "c_mktsegment", F.lit("; s__"))
    return joined.select(F.col("c_custkey").alias("seq_id"), text.alias("lineage"))


LINEAGES_SQL = "SELECT c_custkey AS seq_id, 'k__World; p__' || r_name || '; c__' || n_name || '; o__' || c_mktsegment || '; s__' AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
TOKENS_SQL = "list_transform(list_filter(list_transform(string_split(lineage, ';'), lambda x: ltrim(x)), lambda x: contains(x, '__') AND NOT ends_with(x, '__')), lambda x: translate(x, ' ', '_'))"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- vectors ----

_PAIRS = "FROM embeddings a, embeddings b"


@query(f"""
SELECT input_id, rank, round(score, 6) AS score, db_id FROM (
  SELECT a.vec_id AS input_id, b.vec_id AS db_id, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rank
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) a, (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) b,
    LATERAL (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s) t)
WHERE rank <= 10
""")
def emb_cosine_topk_k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return similarity.cosine_topk(e, e, 10).select("input_id", "rank", F.round("score", 6).alias("score"), "db_id")


@query("""
SELECT a.vec_id AS input_id, round(max(s), 6) AS score, arg_max(b.vec_id, (s, -b.vec_id)) AS db_id
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) a, (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) b,
  LATERAL (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s) t
GROUP BY a.vec_id
""")
def emb_cosine_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return similarity.cosine_argmax(e, e).select("input_id", F.round("score", 6).alias("score"), "db_id")


def _next_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(after, "vec_id").select("vec_id", "embedding", "after")


_NEXT_SQL = "FROM (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"SELECT vec_id, round(list_dot_product(x, y), 6) AS dot {_NEXT_SQL}")
def emb_raw_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_vectors(spark, sf_dir).select("vec_id", F.round(similarity.dot(F.col("embedding"), F.col("after")), 6).alias("dot"))


@query(f"SELECT vec_id, round(1 / sqrt(list_dot_product(x, x)), 6) AS inv_norm, round(2 * (list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) - 0.5), 6) AS score {_NEXT_SQL}")
def emb_norm_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("embedding"), F.col("after")
    return _next_vectors(spark, sf_dir).select("vec_id", F.round(1 / similarity.norm(a), 6).alias("inv_norm"), F.round(2 * (similarity.cosine(a, b) - 0.5), 6).alias("score"))


# ---- DNA ----


@query(f"SELECT doc_id, md5(s) AS sequence_md5, md5({REVCOMP_SQL.format('s')}) AS revcomp_md5 FROM (SELECT doc_id, {WHOLE_SQL} AS s FROM documents)")
def doc_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents_dna(spark, sf_dir)
    return s.select("doc_id", F.md5(F.col("sequence").cast("binary")).alias("sequence_md5"), F.md5(dna.revcomp(F.col("sequence")).cast("binary")).alias("revcomp_md5"))


_KMERS_SQL = f"""
WITH d AS (SELECT doc_id, {WHOLE_SQL} AS s FROM documents),
k AS (SELECT doc_id, s[i : i + 4] AS x FROM (SELECT doc_id, s, unnest(range(1, length(s) - 3)) AS i FROM d WHERE length(s) >= 5)),
c AS (SELECT doc_id, least(x, {REVCOMP_SQL.format('x')}) AS kmer FROM k WHERE regexp_full_match(x, '[ACGT]{{5}}'))
"""


@query(_KMERS_SQL + "SELECT doc_id, kmer, count(*)::BIGINT AS n FROM c GROUP BY doc_id, kmer")
def doc_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.kmer_counts(documents_dna(spark, sf_dir), "doc_id")


@query(_KMERS_SQL + "SELECT kmer, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM c GROUP BY kmer")
def doc_canonical_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = encode.kmer_counts(documents_dna(spark, sf_dir), "doc_id")
    return per_doc.groupBy("kmer").agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).cast("bigint").alias("n_docs"))


def _windows(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    found = dna.windows(documents_dna(spark, sf_dir), rule=rule)
    return found.select("doc_id", F.col("window_start").cast("bigint").alias("window_start"), F.md5(F.col("window").cast("binary")).alias("window_md5"))


_WINDOWS_SQL = f"SELECT doc_id, x AS window_start, md5(s[x + 1 : x + 125]) AS window_md5 FROM (SELECT doc_id, s, unnest(range(0, length(s) - {{0}}, 10)) AS x FROM (SELECT doc_id, {WHOLE_SQL} AS s FROM documents))"


@query(_WINDOWS_SQL.format(125))
def doc_windows_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "cpu")


@query(_WINDOWS_SQL.format(124))
def doc_windows_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "gpu")


@query(f"""
WITH d AS (SELECT doc_id, {WHOLE_SQL} AS s FROM documents),
k AS (SELECT doc_id, length(s) AS n, i, regexp_full_match(s[i + 1 : i + 5], '[ACGT]{{5}}')::INT AS f FROM (SELECT doc_id, s, unnest(range(0, length(s) - 4)) AS i FROM d WHERE length(s) > 125)),
w AS (SELECT doc_id, n, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 120 FOLLOWING) AS n_known FROM k)
SELECT doc_id, i AS window_start, n_known::BIGINT AS n_known FROM w WHERE i % 10 = 0 AND i + 125 < n
""")
def doc_window_kmers_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.sliding_kmer_counts(documents_dna(spark, sf_dir), "doc_id").select("doc_id", F.col("window_start").cast("bigint").alias("window_start"), "n_known")


@query("SELECT list_reduce(list_transform(range(4), lambda i: substr('ACGT', ((c >> (2 * (3 - i))) & 3)::BIGINT + 1, 1)), lambda a, b: a || b) AS nmer, c AS code FROM range(256) r(c)")
def nmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna.nmers(spark, 4)


@query(f"""
WITH d AS (SELECT doc_id, {WHOLE_SQL} AS s FROM documents),
k AS (SELECT doc_id, s[i : i + 10] AS x FROM (SELECT doc_id, s, unnest(range(1, length(s) - 9)) AS i FROM d WHERE length(s) >= 11))
SELECT doc_id, count(*)::BIGINT AS n, sum(code)::BIGINT AS total, max(code)::BIGINT AS most, count(DISTINCT code)::BIGINT AS n_distinct FROM (
  SELECT doc_id, list_reduce(list_transform(range(1, 12), lambda j: strpos('ACGT', x[j]) - 1), lambda a, b: 4 * a + b) AS code FROM k WHERE regexp_full_match(x, '[ACGT]{{11}}')) GROUP BY doc_id
""")
def doc_packed_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all known 11-mers of the packed documents, by shifts over the edges of words."""
    return encode.packed_kmer_sums(encode.pack_sequences(documents_dna(spark, sf_dir)), "doc_id", 11)


@query(f"SELECT doc_id, length(s)::BIGINT AS n_bases, ceil(length(s) / 16.0)::BIGINT AS n_words, md5(s) AS sequence_md5 FROM (SELECT doc_id, {WHOLE_SQL} AS s FROM documents)")
def doc_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, and what unpacking gives."""
    back = encode.unpack_sequences(encode.pack_sequences(documents_dna(spark, sf_dir)), ".")
    return back.select("doc_id", F.col("n").cast("bigint").alias("n_bases"), F.size("words").cast("bigint").alias("n_words"), F.md5(F.col("sequence").cast("binary")).alias("sequence_md5"))


def _bits(base: str) -> str:
    return "".join("1" if x else "0" for x in hv.lanes(hv.bases()[base][None])[0])


def _gram_sql() -> str:
    """G from the four base vectors as bit strings (bit i of a string is lane i)."""
    vectors = ", ".join(f"('{b}', '{_bits(b)}'::BIT)" for b in "ACGT")
    ones = "1" * hv.HV_DIM
    letters = "(SELECT unnest(['A', 'C', 'G', 'T']) AS l)"
    bound = "xor(xor(xor(xor(xor(o.v, b0.v), b1.v << 1), b2.v << 2), b3.v << 3), b4.v << 4)"
    return f"""
b(l, v) AS MATERIALIZED (VALUES {vectors}), o AS (SELECT '{ones}'::BIT AS v),
every AS (SELECT a.l || b.l || c.l || d.l || e.l AS kmer FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e),
h AS MATERIALIZED (SELECT kmer, {bound} AS v FROM every, o JOIN b b0 ON true JOIN b b1 ON true JOIN b b2 ON true JOIN b b3 ON true JOIN b b4 ON true
  WHERE b0.l = kmer[1] AND b1.l = kmer[2] AND b2.l = kmer[3] AND b3.l = kmer[4] AND b4.l = kmer[5] AND kmer <= {REVCOMP_SQL.format('kmer')}),
g AS MATERIALIZED (SELECT x.kmer AS a, y.kmer AS b, (10000 - 2 * bit_count(xor(x.v, y.v)))::BIGINT AS dot FROM h x, h y)
"""


@query(f"""
WITH {_gram_sql()}, n AS (SELECT n_nationkey, CASE WHEN k <= {REVCOMP_SQL.format('k')} THEN k ELSE {REVCOMP_SQL.format('k')} END AS kmer FROM (SELECT n_nationkey, substr('ACGTTGCAACCGGTTATTGACAGTACGTA', n_nationkey + 1, 5) AS k FROM nation))
SELECT n_nationkey, kmer, bit_count(v)::BIGINT AS ones, list_sum(list_transform(range(10000), lambda i: i * get_bit(v, i::INT)))::BIGINT AS places FROM n JOIN h USING (kmer)
""")
def kmer_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes of the vectors of nations' k-mers, unpacked from words."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", dna.canonical(F.substring(F.lit("ACGTTGCAACCGGTTATTGACAGTACGTA"), (F.col("n_nationkey") + 1).cast("int"), F.lit(5))).alias("canonical"))
    dimension = hv.kmer_dimension(spark).where("kmer = canon").select("kmer", "hv")
    bits = rows.join(F.broadcast(dimension), F.col("canonical") == F.col("kmer")).select("n_nationkey", "kmer", hv.lanes_column(F.col("hv")).alias("lanes"))
    places = F.aggregate(F.transform("lanes", lambda x, i: x * i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bits.select("n_nationkey", "kmer", F.aggregate("lanes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones"), places.alias("places"))


@query("WITH " + _gram_sql() + "SELECT a, b, dot FROM g")
def kmer_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G with built-in functions from the k-mer dimension."""
    k = hv.kmer_dimension(spark).where("kmer = canon").select("kmer", "hv")
    x, y = k.select(F.col("kmer").alias("a"), F.col("hv").alias("ha")), k.select(F.col("kmer").alias("b"), F.col("hv").alias("hb"))
    differ = F.aggregate(F.zip_with("ha", "hb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda m, n: m + n)
    return x.crossJoin(F.broadcast(y)).select("a", "b", (F.lit(hv.HV_DIM) - 2 * differ).cast("bigint").alias("dot"))


@query(f"""
WITH {_gram_sql()},
t AS (SELECT 'q' AS side, item_id AS id, {WHOLE_SQL} AS s FROM benchmark UNION ALL SELECT 'd', doc_id, {WHOLE_SQL} FROM documents),
k AS (SELECT side, id, s[i : i + 4] AS x FROM (SELECT side, id, s, unnest(range(1, length(s) - 3)) AS i FROM t WHERE length(s) >= 5)),
c AS MATERIALIZED (SELECT side, id, least(x, {REVCOMP_SQL.format('x')}) AS kmer, count(*) AS n FROM k WHERE regexp_full_match(x, '[ACGT]{{5}}') GROUP BY ALL),
p AS MATERIALIZED (SELECT side, id, b AS kmer, sum(n * dot)::BIGINT AS v FROM c JOIN g ON a = kmer GROUP BY ALL),
norms AS MATERIALIZED (SELECT side, id, sum(n * v)::DOUBLE AS norm2 FROM c JOIN p USING (side, id, kmer) GROUP BY ALL),
dots AS (SELECT p.id AS item_id, c.id AS doc_id, sum(n * v)::DOUBLE AS dot FROM p JOIN c USING (kmer) WHERE p.side = 'q' AND c.side = 'd' GROUP BY ALL),
scores AS (SELECT item_id, doc_id, 2 * (dot / (sqrt(x.norm2) * sqrt(y.norm2)) - 0.5) AS score FROM dots JOIN norms x ON x.side = 'q' AND x.id = item_id JOIN norms y ON y.side = 'd' AND y.id = doc_id)
SELECT q.item_id, d.doc_id, round(coalesce(score, -1), 6) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN scores s ON s.item_id = q.item_id AND s.doc_id = d.doc_id
""")
def doc_hdc_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items (a stated query set) against all documents, whole sequences."""
    items = table(spark, sf_dir, "benchmark").select("item_id", whole_dna(F.coalesce("text", F.lit(""))).alias("sequence"))
    return similarity.score_queries(items, documents_dna(spark, sf_dir), "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


# ---- lineages ----


@query(f"SELECT seq_id, lineage, array_to_string({TOKENS_SQL}, ';') AS tokens FROM ({LINEAGES_SQL})")
def lineage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineages(spark, sf_dir).select("seq_id", "lineage", F.array_join(lineage.lineage_tokens(F.col("lineage")), ";").alias("tokens"))


@query(f"SELECT seq_id, list_filter(list_transform(string_split(lineage, ';'), lambda x: trim(x)), lambda x: contains(x, '__') AND NOT ends_with(x, '__'))[-1] AS lowest FROM ({LINEAGES_SQL})")
def lowest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineages(spark, sf_dir).select("seq_id", lineage.lowest_rank(F.col("lineage")).alias("lowest"))


@query("SELECT p_partkey, translate(p_name || ' (' || p_brand || '/' || p_type || ')', ' /()', '__') AS safe, translate(p_name || ' (' || p_brand || '/' || p_type || ')', ' ', '_') AS normal FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("/"), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", dna.safe_name(name).alias("safe"), dna.normalize_category(name).alias("normal"))


@query(f"SELECT DISTINCT unnest(list_filter(list_transform(string_split(lineage, ';'), lambda x: trim(x)), lambda x: contains(x, '__') AND NOT ends_with(x, '__'))) AS node FROM ({LINEAGES_SQL})")
def taxonomy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.nodes(lineages(spark, sf_dir))


_EDGES_SQL = f"SELECT DISTINCT t[i] AS parent, t[i + 1] AS child FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT {TOKENS_SQL} AS t FROM ({LINEAGES_SQL})))"


@query(_EDGES_SQL)
def taxonomy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.edges(lineages(spark, sf_dir))


@query(f"SELECT DISTINCT parent AS node FROM ({_EDGES_SQL}) WHERE starts_with(parent, 'c__')")
def order_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.nodes_at(taxonomy.edges(lineages(spark, sf_dir)), "c__")


@query(f"""
WITH RECURSIVE e AS ({_EDGES_SQL}), d(ancestor, descendant, path) AS (
  SELECT parent, child, child FROM e UNION ALL SELECT ancestor, child, path || '|' || child FROM d JOIN e ON descendant = parent)
SELECT ancestor, descendant, path FROM d
""")
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.descendants_of(lineages(spark, sf_dir)).select("ancestor", "descendant", F.array_join("path", "|").alias("path"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves of a tree of region, nation and segment: labels carry their parents', so that each has one way."""
    label = F.concat(F.lit("k__World; p__"), "r_name", F.lit("; c__"), "n_name", F.lit("; o__"), "n_name", F.lit("-"), "c_mktsegment", F.lit("; s__"), F.col("c_custkey").cast("string"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(label.alias("lineage"))


_TREE_SQL = """
WITH t AS (SELECT ['k__World', 'p__' || r_name, 'c__' || translate(n_name, ' ', '_'), 'o__' || translate(n_name || '-' || c_mktsegment, ' ', '_'), 's__' || c_custkey] AS t
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT DISTINCT list_transform(t[1 : k], lambda x: translate(x, ' ', '_')) AS way FROM t, range(1, 6) r(k)),
n AS (SELECT way, way[-1] AS node, row_number() OVER (ORDER BY array_to_string(list_transform(way, lambda x: encode(x)::VARCHAR), chr(1))) - 1 AS first FROM w),
e AS (SELECT n.node, n.way, n.first, n.first + (SELECT count(*) FROM n d WHERE d.way[len(n.way)] = n.node) - 1 AS last FROM n)
"""


@query(_TREE_SQL + "SELECT node, way[-2] AS parent, len(way) AS depth, first, last FROM e")
def taxonomy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler-tour numbers of all nodes."""
    return taxonomy.intervals(stored(taxonomy.paths(_tree(spark, sf_dir)), "paths"))


@query(_TREE_SQL + "SELECT a.node AS ancestor, d.node AS descendant, d.first FROM e a JOIN e d ON d.first > a.first AND d.first <= a.last WHERE starts_with(a.node, 'c__')")
def taxonomy_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each class, by intervals."""
    tour = stored(taxonomy.intervals(stored(taxonomy.paths(_tree(spark, sf_dir)), "paths")), "tour")
    return taxonomy.subtrees(tour.where(F.col("node").startswith("c__")), tour)


@query("""
WITH p AS (SELECT c_custkey AS seq_id, 'Bacteria;' || r_name || ';' || CASE WHEN c_custkey % 7 = 0 THEN 'Uncultured' ELSE n_name END || ';' || CASE WHEN c_custkey % 5 = 0 THEN 'unidentified' ELSE c_mktsegment END AS path, r_name, n_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT seq_id, CASE WHEN seq_id % 7 = 0 THEN NULL ELSE 'k__Bacteria' || CASE WHEN r_name = 'ASIA' THEN '' ELSE ';p__' || r_name END || CASE WHEN r_name = 'ASIA' THEN '' ELSE ';c__' || n_name END || CASE WHEN seq_id % 5 = 0 THEN '' ELSE ';s__' || c_mktsegment END END AS lineage FROM p
""")
def prefixed_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain paths of customers with ranks of regions and nations; ASIA has no known ranks."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    nation = F.when(F.col("c_custkey") % 7 == 0, F.lit("Uncultured")).otherwise(F.col("n_name"))
    segment = F.when(F.col("c_custkey") % 5 == 0, F.lit("unidentified")).otherwise(F.col("c_mktsegment"))
    path = F.concat(F.lit("Bacteria;"), "r_name", F.lit(";"), nation, F.lit(";"), segment)
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    known = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'")
    first = known.select(F.concat(F.lit("Bacteria;"), "r_name", F.lit(";")).alias("path"), F.lit("phylum").alias("rank")).distinct()
    second = known.select(F.concat(F.lit("Bacteria;"), "r_name", F.lit(";"), "n_name", F.lit(";")).alias("path"), F.lit("class").alias("rank"))
    named = rows.select(F.col("c_custkey").alias("seq_id"), path.alias("description"))
    return named.join(lineage.prefixed_lineages(named, first.union(second)), F.col("description") == F.col("path"), "left").select("seq_id", "lineage")


# ---- database ----


def _library(spark: SparkSession, sf_dir: str):
    """Documents as a library: lineage by language and source, sequence from the text."""
    lean_batches(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    label = F.concat(F.lit("k__Docs; p__"), "lang", F.lit("; c__"), "lang", F.lit("-"), "source")
    return docs.select(F.col("doc_id").cast("string").alias("seq_id"), encode.dna_column(F.coalesce("text", F.lit(""))).alias("sequence"), label.alias("lineage"))


@query("SELECT 'c__' || lang || '-' || source AS category, count(*)::BIGINT AS n_sequences, sum(length(coalesce(text, '')))::BIGINT AS n_bases FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _library(spark, sf_dir)
    found = induct_pairs(rows.select("seq_id", "sequence"), rows.select("seq_id", "lineage"))
    return found.sequences.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("n_sequences"), F.sum(F.length("sequence")).cast("bigint").alias("n_bases"))


@query(f"SELECT name, md5(s) AS sequence_md5, n FROM (SELECT s, arg_min(doc_id, doc_id)::VARCHAR AS name, count(*)::BIGINT AS n FROM (SELECT doc_id, {WHOLE_SQL} AS s FROM documents) WHERE s <> '' GROUP BY s)")
def dedupe_first_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_dna(spark, sf_dir).where("sequence <> ''").select(F.col("doc_id").cast("string").alias("name"), "sequence", F.col("doc_id").alias("ord"))
    n = rows.groupBy("sequence").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return identify.distinct_queries(rows).join(n, "sequence").select("name", F.md5(F.col("sequence").cast("binary")).alias("sequence_md5"), "n")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").cast("string").alias("name"), whole_dna(F.coalesce("text", F.lit(""))).alias("sequence"), F.col("item_id").alias("ord"))


def _induced(spark: SparkSession, sf_dir: str):
    rows = _library(spark, sf_dir)
    return induct_pairs(rows.select("seq_id", "sequence"), rows.select("seq_id", "lineage"))


@query()
def propagate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _induced(spark, sf_dir)
    return propagate.propagate(found.sequences, found.index)[1]


@query()
def propagate_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _induced(spark, sf_dir)
    return propagate.propagate(found.sequences, found.index)[0].select("category", "sequence")


@query()
def identify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items walk the taxonomy of documents, each document's sequence also standing at its ancestors by propagation."""
    found = _induced(spark, sf_dir)
    sequences = stored(found.sequences, "sequences")
    more = stored(propagate.propagate(sequences, found.index)[0].select("category", "sequence"), "more")
    library = sequences.unionByName(more.select("category", F.md5(F.col("sequence").cast("binary")).alias("seq_id"), "sequence"))
    out = identify.identify(_queries(spark, sf_dir), library, found.index)
    return out.select("query_id", "name", F.array_join("path", ";").alias("path"), F.transform("path_scores", lambda x: F.round(x, 6)).alias("path_scores"), "status")


#: Rows of the cost table as lists (``d`` by prefix length ``i``), then the way back from the first end with the fewest errors.
_ALIGN_SQL = f"""
WITH RECURSIVE s AS (SELECT item_id, {WHOLE_SQL} AS s FROM benchmark),
p AS MATERIALIZED (SELECT q.item_id AS id, r.s AS r, q.s AS q FROM s q JOIN s r ON r.item_id = q.item_id - 1),
d(id, i, costs) AS (
  SELECT id, 0::BIGINT, list_transform(range(length(r) + 1), lambda x: 0::BIGINT) FROM p
  UNION ALL
  SELECT id, i + 1, list_reduce(list_transform(base, lambda x: [x]), lambda a, b: list_append(a, least(b[1], a[-1] + 1))) FROM (
    SELECT d.id, d.i, list_prepend(d.i + 1, list_transform(range(length(r)), lambda j: least(d.costs[j + 2] + 1, d.costs[j + 1] + CASE WHEN substr(r, (j + 1)::BIGINT, 1) = substr(q, (d.i + 1)::BIGINT, 1) THEN 0 ELSE 1 END))) AS base
    FROM d JOIN p USING (id) WHERE d.i < length(q))),
c AS MATERIALIZED (SELECT * FROM d),
e AS MATERIALIZED (SELECT p.id, list_position(costs, list_min(costs)) - 1 AS stop, list_min(costs) AS errors FROM p JOIN c ON c.id = p.id AND c.i = length(q)),
b(id, i, j, ar, sy, aq) AS (
  SELECT p.id, length(q)::BIGINT, stop::BIGINT, '', '', '' FROM p JOIN e USING (id)
  UNION ALL
  SELECT id, CASE WHEN step = 2 THEN i ELSE i - 1 END, CASE WHEN step = 1 THEN j ELSE j - 1 END,
    CASE WHEN step = 1 THEN '-' ELSE x END || ar, CASE step WHEN 1 THEN 'I' WHEN 2 THEN 'D' ELSE CASE WHEN x = y THEN '|' ELSE '*' END END || sy, CASE WHEN step = 2 THEN '-' ELSE y END || aq
  FROM (SELECT b.*, substr(r, b.j, 1) AS x, substr(q, b.i, 1) AS y, CASE WHEN now.costs[b.j + 1] = above.costs[b.j + 1] + 1 THEN 1 WHEN b.j > 0 AND now.costs[b.j + 1] = now.costs[b.j] + 1 THEN 2 ELSE 3 END AS step
    FROM b JOIN p ON p.id = b.id JOIN c now ON now.id = b.id AND now.i = b.i JOIN c above ON above.id = b.id AND above.i = b.i - 1))
SELECT e.id::VARCHAR AS name, j::INT AS start, stop::INT AS stop, errors::INT AS min_errors, ar AS aligned_reference, sy AS symbols, aq AS aligned_query FROM b JOIN e ON e.id = b.id WHERE i = 0
"""


@query(_ALIGN_SQL)
def align_semiglobal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the item before it."""
    q = _queries(spark, sf_dir)
    before = q.select((F.col("ord") + 1).alias("ord"), F.col("sequence").alias("reference"))
    found = q.join(before, "ord").select("name", align.semiglobal(F.col("reference"), F.col("sequence")).alias("a"))
    return found.select("name", "a.*").withColumnRenamed("end", "stop")


_COLOURED = "list_transform(range(1, length({0}) + 1), lambda i: CASE substr(symbols, i, 1) WHEN '|' THEN chr(27) || '[92m' WHEN '*' THEN chr(27) || '[91m' WHEN 'I' THEN chr(27) || '[93m' ELSE chr(27) || '[94m' END || substr({0}, i, 1) || chr(27) || '[0m')"


@query(f"SELECT name, md5(array_to_string({_COLOURED.format('aligned_reference')}, '')) AS reference_md5, md5(array_to_string({_COLOURED.format('aligned_query')}, '')) AS query_md5 FROM ({_ALIGN_SQL})")
def align_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coloured lines of the alignments."""
    found = align_semiglobal(spark, sf_dir)
    line = lambda c: F.md5(align.coloured_column(F.col(c), F.col("symbols")).cast("binary"))
    return found.select("name", line("aligned_reference").alias("reference_md5"), line("aligned_query").alias("query_md5"))


def _unit(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 10))::BIGINT::DOUBLE + 0.5) / 1099511627776.0::DOUBLE)"


_SIMULATE_SQL = f"""
WITH lib AS MATERIALIZED (SELECT 's__' || lang || '-' || source AS category, doc_id::VARCHAR AS seq_id, {WHOLE_SQL} AS s, 'k__Docs; p__' || lang || '; c__' || lang || '-' || source AS lineage FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
own AS (SELECT * FROM lib WHERE s <> ''),
taxa AS (SELECT category, -ln({_unit("'1:w:' || category")}) AS w FROM (SELECT DISTINCT category FROM own) ORDER BY md5('1:' || category) LIMIT 25),
shares AS (SELECT category, greatest(1, floor(w / sum(w) OVER () * 10000))::BIGINT AS n FROM taxa),
topped AS MATERIALIZED (SELECT category, n + short // 25 + CASE WHEN row_number() OVER (ORDER BY category) - 1 < short % 25 THEN 1 ELSE 0 END AS n FROM shares, (SELECT greatest(0, 10000 - sum(n))::BIGINT AS short FROM shares)),
templates AS MATERIALIZED (SELECT * FROM (SELECT own.*, row_number() OVER (PARTITION BY category ORDER BY md5('1:' || seq_id), seq_id) - 1 AS t FROM own JOIN topped USING (category)) WHERE t < 50),
sizes AS (SELECT category, count(*) AS k FROM templates GROUP BY category),
reads AS (SELECT category, r, floor({_unit("'1:t:' || category || ':' || r")} * k)::BIGINT AS t, (90 + floor({_unit("'1:l:' || category || ':' || r")} * 36))::INT AS final_len FROM (SELECT category, unnest(range(1, n + 1)) AS r FROM topped) JOIN sizes USING (category)),
cut AS (SELECT category, r, lineage, seq_id, final_len, substr(s, (floor({_unit("'1:s:' || category || ':' || r")} * (greatest(length(s) - 125, 0) + 1)) + 1)::BIGINT, 125) AS piece FROM reads JOIN templates USING (category, t))
SELECT printf('read_%08d', row_number() OVER (ORDER BY category, r)) AS read_id, lineage AS taxonomy, seq_id AS template_id, 125 AS orig_len, final_len, piece[1:final_len] AS sequence, repeat('I', final_len) AS quality FROM cut WHERE length(piece) >= final_len
"""


@query(_SIMULATE_SQL)
def simulate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _library(spark, sf_dir)
    library = rows.select(F.concat(F.lit("s__"), F.regexp_extract("lineage", "c__(.*)$", 1)).alias("category"), "seq_id", "sequence")
    return sample.simulate_reads(library, rows.select("seq_id", "lineage"))


@query("SELECT source, n_docs, (sum(n_docs) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_docs)::BIGINT AS first_offset, row_number() OVER (ORDER BY source) AS ordinal FROM (SELECT source, count(*)::BIGINT AS n_docs FROM documents GROUP BY source)")
def window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets and ordinals over the (few) sources."""
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))
    order = Window.orderBy("source")
    before = F.sum("n_docs").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_docs")
    return per.select("source", "n_docs", before.cast("bigint").alias("first_offset"), F.row_number().over(order).cast("bigint").alias("ordinal"))


from kmerloom.plans import files, search  # noqa: E402, F401  these register their queries
