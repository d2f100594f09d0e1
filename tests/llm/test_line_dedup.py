import collections
import math
import re

from kmerloom.llm import line_dedup as ld


def lower(n, of, z):
    p = n / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def brute(rows, ratio=ld.RATIO, z=ld.Z, least=ld.LEAST):
    pages, seen = collections.Counter(), collections.Counter()
    for _, text, host in rows:
        pages[host] += 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if len(line.replace("\t", " ").split(" ")) > 1 and re.search(r"[^ \t][ \t]+[^ \t]", line):
                seen[host, line] += 1
    gone = {k for k, n in seen.items() if n >= least and lower(n, pages[k[0]], z) > ratio}
    out = []
    for i, text, host in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host, x) not in gone]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()]
    rows += [(500 + k, f"All rights reserved.\nown line {k}\n\nAll rights reserved.", "b") for k in range(8)] + [(600 + k, f"the menu\n{k}", None) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = brute(rows)
    for most in (100_000, 0):
        found = ld.boilerplate(docs)
        got = ld.drop_lines(docs, found, most_rows=most).select("row.doc_id", "row.text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[3] for r in want) >= 22


def test_keeps_columns_and_takes_empty(odd, empty):
    assert ld.line_dedup(odd).select("row.*").columns == odd.columns
    assert ld.line_dedup(odd).count() == odd.count()
    assert ld.line_dedup(empty).count() == 0


def test_one_ratio_decides_on_sites_of_any_size(spark):
    """Lines just above and below the bound on sites of 60, 500 and 5,000 pages; single words stay."""
    rows = []
    for size in (60, 500, 5000):
        most = next(n for n in range(1, size) if lower(n, size, ld.Z) > ld.RATIO)
        for k in range(size):
            lines = ["Les."] + ["main menu"] * (k < most) + ["nearly often"] * (k < most - 1)
            rows.append((10_000 * size + k, "\n".join([*lines, f"own {k}"]), f"s{size}"))
    got = {r.doc_id: (r.text, r.n_dropped) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("row.doc_id", "row.text", "n_dropped").collect()}
    assert got == {i: (t, n) for i, t, _, n in brute(rows)}
    assert sum(n for _, n in got.values()) == sum(next(n for n in range(1, s) if lower(n, s, ld.Z) > ld.RATIO) for s in (60, 500, 5000))
    assert all(t.startswith("Les.") for t, _ in got.values())


def test_the_ratio_decides_on_the_tables(spark):
    """On 1,000 documents the set ratio, none and a large one drop different lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    n = {ratio: ld.line_dedup(docs, ratio).agg({"n_dropped": "sum"}).first()[0] for ratio in (0.0, ld.RATIO, 0.03)}
    assert n[0.0] >= n[ld.RATIO] > n[0.03]
    none = ld.line_dedup(docs, 0.0, least=1).agg({"n_dropped": "sum"}).first()[0]
    assert none > 20 * n[ld.RATIO]


def test_hosts_of_urls(spark):
    urls = ["http://A.example.com:80/x?y#z", "https://me:pw@b.org", "ftp://c.net?q", "no url", "", None, "//d.org/x"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "url string").select(ld.url_host(ld.F.col("url")).alias("h")).collect()]
    assert got == ["a.example.com", "b.org", "c.net", None, None, None, None]
    pages = spark.createDataFrame([(k, f"http://{h}.org/{k}", f"menu {h}\npage {k}") for k, h in enumerate("aaaaaabbbbbbb" + "c" * 4)], "page_id bigint, url string, text string")
    out = ld.line_dedup(pages.withColumn("host", ld.url_host(ld.F.col("url"))), host_col="host")
    assert {(r.row.page_id, r.n_dropped) for r in out.select("row", "n_dropped").collect()} == {(k, 1) for k in range(17)}


def test_a_text_over_a_mebibyte(spark):
    rows = [(1, "the menu\n" + "\n".join(f"line {k}" for k in range(150_000)), "a")] + [(k, f"the menu\nown {k}", "a") for k in range(2, 9)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("row.doc_id", "n_lines", "n_dropped").collect()}
    assert got == {1: (150_001, 1)} | {k: (2, 1) for k in range(2, 9)}
