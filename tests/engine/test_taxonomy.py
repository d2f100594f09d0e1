import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import lineage
from kmerloom.operators import align, encode, identify, propagate, sample, similarity, taxonomy
from kmerloom.operators.induct import induct_headers, induct_pairs, induct_two_files
from kmerloom.operators.induct import write as write_induced
from kmerloom.sources import fasta
from test_similarity import random_dna


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


def test_lineage_strings(spark):
    text = "k__B;  p__Firm icutes; c__; junk; s__ "
    assert one(spark, text, lineage.lineage_tokens) == ["k__B", "p__Firm_icutes", "s___"]
    assert one(spark, text, lineage.all_ranks) == ["k__B", "p__Firm icutes"]
    assert one(spark, text, lineage.lowest_rank) == "p__Firm icutes" and one(spark, "x;y", lineage.lowest_rank) == "unclassified"
    assert one(spark, "Bacteria;x", lineage.is_bacterial) and not one(spark, "Archaea;Bacteria;x", lineage.is_bacterial)


def test_prefixed_taxonomy(spark):
    ranks = F.create_map(*[F.lit(x) for kv in {"Bacteria;P;": "phylum", "Bacteria;P;C;": "class", "Bacteria;P;C;X;": "odd"}.items() for x in kv])
    f = lambda s: one(spark, s, lambda c: lineage.prefixed_taxonomy(c, ranks))
    assert f("Bacteria;P;C;X;Sp one") == "k__Bacteria;p__P;c__C;s__Sp one"
    assert f("Root;Bacteria; ;P;Uncultured") == "k__Bacteria;p__P" and f("Bacteria;P;unidentified;S") is None
    assert f("Archaea;P") is None and f("Bacteria") == "k__Bacteria" and f("Bacteria;Solo") == "k__Bacteria;s__Solo"


def test_graph(spark):
    index = spark.createDataFrame([("k__B; p__P; c__C; s__S",), ("k__B; p__P; c__; s__T",), ("k__B; p__Lone",)], "lineage string")
    graph = taxonomy.edges(index)
    assert {tuple(r) for r in graph.collect()} == {("k__B", "p__P"), ("p__P", "c__C"), ("c__C", "s__S"), ("p__P", "s__T"), ("k__B", "p__Lone")}
    assert [r.node for r in taxonomy.nodes_at(graph, "p__").collect()] == ["p__P"]
    assert taxonomy.nodes(index).count() == 6
    down = {(r.ancestor, r.descendant): r.path for r in taxonomy.descendants(graph).collect()}
    assert down["k__B", "s__S"] == ["p__P", "c__C", "s__S"] and len(down) == 5 + 3 + 1
    with pytest.raises(ValueError):
        taxonomy.descendants(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"), most_steps=5)


@pytest.fixture(scope="module")
def world(spark):
    r0, r1, r2 = random_dna(10, 700), random_dna(11, 600), random_dna(12, 500)
    r3 = r0[:350] + random_dna(13, 350)
    rows = [("a", r0, "k__B; p__P1; c__C1; o__O1; f__F1; g__G1; s__S0"), ("b", r3, "k__B; p__P1; c__C1; o__O1; f__F1; g__G1; s__S3"), ("c", r2, "k__B; p__P2; c__C2; o__O2; f__F2; g__G2; s__S2"), ("d", r1, "k__B; p__P3; c__C3")]
    df = spark.createDataFrame(rows, "seq_id string, sequence string, lineage string")
    return rows, induct_pairs(df.select("seq_id", "sequence"), df.select("seq_id", "lineage"))


def test_propagate_and_identify(spark, world):
    rows, found = world
    new, histogram = propagate.propagate(found.sequences, found.index)
    added = {(r.category, r.sequence) for r in new.collect()}
    assert ("p__P1", rows[0][1]) in added and ("p__P3", rows[3][1]) in added
    assert not any(c.startswith("k__") for c, _ in added)
    assert histogram.agg(F.sum("n")).first()[0] == 2 * 5 + 5 + 1
    library = fasta.append_sequences(found.sequences, new)
    names = {r.seq_id for r in library.where("category = 'p__P3'").collect()}
    assert names == {"p__P3_appended_1"}
    reads = [("q1", rows[1][1][500:625]), ("q2", rows[2][1][100:220]), ("q1 again", rows[1][1][500:625]), ("alien", "CG" * 62)]
    queries = spark.createDataFrame([(n, s, k) for k, (n, s) in enumerate(reads)], "name string, sequence string, ord bigint")
    got = {r.name: r for r in identify.identify(queries, library, found.index).collect()}
    assert set(got) == {"q1", "q2", "alien"}
    assert got["q1"].path == ["p__P1", "c__C1", "o__O1", "f__F1", "g__G1", "s__S3"] and got["q1"].status == "COMPLETE"
    assert got["q2"].path[-1] == "s__S2" and min(got["q2"].path_scores) > 0.9
    assert got["alien"].status == "EARLY_EXIT" and len(got["alien"].path) == 1 and got["alien"].path_scores[0] < 0
    lines = {r.x for r in identify.identify(queries, library, found.index).select(identify.result_line(F.col("name"), F.col("path"), F.col("path_scores"), F.col("status")).alias("x")).collect()}
    assert "alien:" in lines and any(x.startswith("q1: p__P1 (") for x in lines)


def test_leaf_repeats_in_the_path(spark, world):
    rows, found = world
    library = fasta.append_sequences(found.sequences, propagate.propagate(found.sequences, found.index)[0])
    queries = spark.createDataFrame([("q", rows[3][1][50:170], 0)], "name string, sequence string, ord bigint")
    assert identify.identify(queries, library, found.index).first().path == ["p__P3", "c__C3", "c__C3", "c__C3", "c__C3", "c__C3"]


def test_greedy_order(spark):
    a, b = random_dna(1, 400), random_dna(2, 400)
    index = spark.createDataFrame([("k__K; p__P; s__A",), ("k__K; p__P; s__B",)], "lineage string")
    library = spark.createDataFrame([("p__P", "x", b), ("s__A", "1", a), ("s__A", "2", a), ("s__B", "3", b), ("s__B", "4", a[:380])], "category string, seq_id string, sequence string")
    got = {(r.seq_id, r.added, round(r.best_score, 2)) for r in propagate.score_descendants(library, index).collect()}
    assert {(i, s) for i, s, _ in got} == {("1", True), ("2", False), ("3", False), ("4", False)}


def test_align_goldens():
    assert align.align("GGACGTACGTGG", "ACGTACGT") == {"start": 2, "end": 10, "min_errors": 0, "aligned_reference": "ACGTACGT", "symbols": "||||||||", "aligned_query": "ACGTACGT"}
    got = align.align("TTACGGT", "ACTGGT")
    assert got["min_errors"] == 1 and got["end"] == 7
    assert align.align("", "AB")["min_errors"] == 2 and align.align("AB", "")["min_errors"] == 0


def test_align_equals_the_least_levenshtein_over_substrings():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for seed in range(25):
        r, q = random_dna(seed, 12), random_dna(seed + 100, 6)
        got = align.align(r, q)
        assert got["min_errors"] == min(lev(r[i:j], q) for i in range(13) for j in range(i, 13))
        assert got["aligned_query"].replace("-", "") == q and got["aligned_reference"].replace("-", "") == r[got["start"] : got["end"]]
        assert sum(s != "|" for s in got["symbols"]) == got["min_errors"]


def test_align_column(spark):
    df = spark.createDataFrame([("GGACGT", "ACG"), (None, "A")], "r string, q string")
    assert [x.a.min_errors for x in df.select(align.semiglobal(F.col("r"), F.col("q")).alias("a")).collect()] == [0, 1]
    assert align.coloured("A-", "|I") == "\033[92mA\033[0m\033[93m-\033[0m"


def test_simulated_reads(spark):
    library = spark.createDataFrame([(f"s__{k}", f"t{k}-{j}", random_dna(10 * k + j, 400)) for k in range(4) for j in range(3)] + [("s__0", "tiny", "ACGT"), ("g__x", "no", random_dna(1, 300))], "category string, seq_id string, sequence string")
    lineages = library.where("category = 's__1'").select("seq_id", F.lit("k__B; s__1").alias("lineage"))
    reads = sample.simulate_reads(library, lineages, total_reads=300, num_taxa=4, max_templates=3)
    rows = reads.collect()
    source = {r.seq_id: r.sequence for r in library.collect()}
    assert 0.7 * 300 <= len(rows) <= 300 and len({r.read_id for r in rows}) == len(rows)
    assert all(r.sequence in source[r.template_id] and 90 <= r.final_len == len(r.sequence) <= 125 for r in rows)
    assert {r.taxonomy for r in rows} == {"NA", "k__B; s__1"} and sorted(map(tuple, rows)) == sorted(map(tuple, reads.collect()))
    with pytest.raises(ValueError):
        sample.simulate_reads(library, lineages, num_taxa=9)


def test_files(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">id1 some words\nACGT\nAC GT \n>id2\n\n>id1 other\nTTTT\n>id3 Bacteria;P;Sp\nGG\n>id4 Archaea;Q;Sp\nCC\n")
    (tmp_path / "tax.tsv").write_text("id1\tk__B; p__P; s__\nid2\tk__B\nid3\tk__B; p__Q\nid4\tx\nid1\tk__B; p__Last\n")
    (tmp_path / "ranks.tsv").write_text("Bacteria;P;\t1\tphylum\nshort\tline\nBacteria;\t2\tdomain\tmore\n")
    path = f"{tmp_path}/x.fasta"
    full = fasta.read_fasta(spark, path)
    assert [(r.seq_id, r.sequence) for r in full.orderBy("ord").collect()] == [("id1 some words", "ACGTAC GT"), ("id1 other", "TTTT"), ("id3 Bacteria;P;Sp", "GG"), ("id4 Archaea;Q;Sp", "CC")]
    token = fasta.read_fasta(spark, path, "token", keep_empty=True)
    assert {(r.seq_id, r.sequence) for r in fasta.last_by_id(token).collect()} >= {("id1", "TTTT"), ("id2", "")}
    assert fasta.read_fasta(spark, f"{tmp_path}/none.fasta").count() == 0
    found = induct_two_files(spark, path, f"{tmp_path}/tax.tsv")
    assert {(r.category, r.seq_id) for r in found.sequences.collect()} == {("p__Last", "id1"), ("k__B", "id2"), ("p__Q", "id3"), ("unclassified", "id4")}
    assert {r.node: r.n_sequences for r in found.nodes.collect()} == {"k__B": 1, "p__Last": 2, "p__Q": 1}
    headers = induct_headers(spark, path, f"{tmp_path}/ranks.tsv")
    assert [tuple(r) for r in headers.index.collect()] == [("id3", "s__Sp", "k__Bacteria;p__P;s__Sp")]
    write_induced(headers, f"{tmp_path}/db", as_fasta=True)
    index = fasta.read_taxonomy_index(spark, f"{tmp_path}/db/taxonomy_index.tsv", header=False, strict=True)
    assert [(r.seq_id, r.lowest, r.lineage) for r in index.collect()] == [("id3", "s__Sp", "k__Bacteria;p__P;s__Sp")]
    assert fasta.read_taxonomy_index(spark, f"{tmp_path}/db/taxonomy_index.tsv").count() == 0
    assert fasta.read_category(spark.read.parquet(f"{tmp_path}/db/sequences"), "s__Sp").first().sequence == "GG"
    with pytest.raises(Exception, match="no lineage"):
        induct_pairs(token.select("seq_id", "sequence"), fasta.read_taxonomy(spark, f"{tmp_path}/tax.tsv").limit(0)).sequences.collect()


def test_reads_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([("read_1", "k__B", "t", 125, 3, "ACG", "III"), ("read_2", "NA", "t", 125, 2, "TT", "I@")], "read_id string, taxonomy string, template_id string, orig_len int, final_len int, sequence string, quality string")
    fasta.write_reads(reads.coalesce(1), f"{tmp_path}/r")
    got = [(r.read_id, r.sequence, r.quality) for r in fasta.read_fastq(spark, f"{tmp_path}/r.fastq").orderBy("ord").collect()]
    assert got == [("read_1", "ACG", "III"), ("read_2", "TT", "I@")]
    assert fasta.read_fasta(spark, f"{tmp_path}/r.fasta").count() == 2
    (tmp_path / "cut.fastq").write_text("@a\nACGT\n+\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        fasta.read_fastq(spark, f"{tmp_path}/cut.fastq").collect()


def test_category_files(spark, tmp_path):
    for name in ("s__b.fasta", "s__a.fasta", "g__c.fasta", "s__d.txt"):
        (tmp_path / name).write_text(">x\nA\n")
    assert [r.category for r in fasta.category_files(spark, str(tmp_path)).collect()] == ["s__a", "s__b"]


def test_marks_within_headers_and_colons(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">id1 Bacteria;A->B;C\r\nAC\r\nGT\r\n>id2:7:x > y\nT>T\n\n>id3\nA")
    path = f"{tmp_path}/x.fasta"
    got = [(r.seq_id, r.description, r.sequence) for r in fasta.read_fasta(spark, path, "lineage").orderBy("ord").collect()]
    assert got == [("id1", "Bacteria;A->B;C", "ACGT"), ("id2:7:x", "> y", "T>T"), ("id3", "", "A")]
    assert [r.seq_id for r in fasta.read_fasta(spark, path, "colon").orderBy("ord").collect()] == ["id1", "id2", "id3"]


def test_ranks_by_join_equal_ranks_by_map(spark):
    paths = ["Bacteria;P;C;X;Sp one", "Root;Bacteria; ;P;Uncultured", "Bacteria;P;unidentified;S", "Archaea;P", "Bacteria", "Bacteria;Solo", "Bacteria;P;C", "x;Bacteria;Bacteria;P;q"]
    known = {"Bacteria;P;": "phylum", "Bacteria;P;C;": "class", "Bacteria;P;C;X;": "odd"}
    ranks = spark.createDataFrame(list(known.items()), "path string, rank string")
    as_map = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    rows = spark.createDataFrame([(p,) for p in paths] * 2, "description string")
    want = {r.description: r.l for r in rows.select("description", lineage.prefixed_taxonomy(F.col("description"), as_map).alias("l")).collect()}
    got = {r.path: r.lineage for r in lineage.prefixed_lineages(rows, ranks).collect()}
    assert got == {p: v for p, v in want.items() if v is not None}


def test_coverage():
    assert sample.coverage(100, 125, 5000) == 2.5


@pytest.mark.parametrize("mode", ["direct", "incremental"])
def test_reference_pieces_hold_the_windows(spark, mode, monkeypatch):
    """Scores over pieces of sequences equal the best over all windows, one by one."""
    monkeypatch.setattr(identify, "PIECE_WINDOWS", 3)
    rows = [("a", "1", random_dna(5, 900)), ("a", "2", random_dna(6, 125)), ("a", "3", random_dna(7, 40)), ("b", "4", random_dna(8, 136)), ("b", "5", "N" * 300)]
    library = spark.createDataFrame(rows, "category string, seq_id string, sequence string")
    asked = encode.encode_sequences(spark.createDataFrame([(1, rows[0][2][300:425]), (2, random_dna(9, 125))], "query_id bigint, sequence string")).select("query_id", "ids")
    pairs = asked.crossJoin(library.select("category").distinct())
    got = {(r.query_id, r.category): r.score for r in identify.score_candidates(pairs, identify.reference_blocks(library, mode), mode=mode).collect()}
    windows = encode.encode_windows(library, mode=mode).collect()
    for q in asked.collect():
        for c in "ab":
            lists = [np.array(w.ids, np.int64) for w in windows if w.category == c]
            scores = similarity.score_matrix(encode.counts_of(np.array(q.ids))[None], np.stack([encode.counts_of(x) for x in lists]))
            assert abs(got[q.query_id, c] - max(-1.0, scores.max())) < 1e-12
    blocks = identify.reference_blocks(library, mode).collect()
    assert sorted(x for b in blocks for x in b.norm2) == sorted(w.norm2 for w in windows)


def test_fastq_over_many_splits(spark, tmp_path):
    """Records that lie across the splits of a file come out whole, in order."""
    for name, n in (("a", 400), ("b", 90)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{name}{k}\n{'ACGT' * (k % 5)}A\n+\n{'@III' * (k % 5)}I\n" for k in range(n)))
    for size in (1000, 37, 1):
        table = fasta.read_fastq(spark, str(tmp_path), range_bytes=size) if size > 1 else fasta.read_fastq(spark, str(tmp_path))
        _fastq_rows(table.collect())
    assert fasta.read_fastq(spark, str(tmp_path), range_bytes=1000).rdd.getNumPartitions() > 10


def _fastq_rows(rows):
    want = [(f"{name}{k}", "ACGT" * (k % 5) + "A", "@III" * (k % 5) + "I") for name, n in (("a", 400), ("b", 90)) for k in range(n)]
    assert sorted((r.read_id, r.sequence, r.quality) for r in rows) == sorted(want)
    own = sorted((r for r in rows if r.read_id[0] == "a"), key=lambda r: r.ord)
    assert [r.read_id for r in own] == [f"a{k}" for k in range(400)]


@pytest.mark.parametrize("mode", ["direct", "incremental"])
def test_products_over_panes(mode):
    """Sums over panes equal the products with every window's counts, in single and in double precision."""
    texts = [(0, random_dna(1, 125 + 10 * 6), 7), (2, random_dna(2, 125), 1), (0, random_dna(3, 60), 1), (0, "", 1), (0, random_dna(4, 90) + "N" * 30 + random_dna(5, 115), 12)]
    pieces = pa.array([{"k": k, "piece": s, "n_windows": n, "stale": "ACGTA"} for k, s, n in texts])
    counts = np.random.default_rng(1).integers(0, 9, (5, 512)).astype(float)
    windows = identify._window_matrix(pieces, mode)
    for scale in (1, 1 << 20):
        v = counts * scale
        assert (identify._products(v, pieces, mode) == v @ windows.T).all()


def test_best_scores_are_the_full_scores():
    r = np.random.default_rng(2)
    dots, q, w = r.integers(-1000, 1000, (40, 90)).astype(float), r.integers(0, 3, 40) * 1000.0, r.integers(0, 4, 90) * 777.0
    dots[:, 50:60] = dots[:, 40:50]
    dots[5] = -abs(dots[5])
    want = similarity.normalized(dots, q[:, None], w[None, :]).max(1)
    assert (np.maximum(identify._best_scores(dots, q, w), -1.0) == np.maximum(want, -1.0)).all()
    assert (np.maximum(identify._best_scores(dots, q, np.zeros(90)), -1.0) == -1.0).all()
    assert (np.maximum(identify._best_scores(dots, q, np.zeros(90)), -1.0) == -1.0).all()
    assert len(identify._best_scores(np.zeros((0, 3)), np.zeros(0), np.ones(3))) == 0
