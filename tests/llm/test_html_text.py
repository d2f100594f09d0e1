import pytest

from kmerloom.llm import html_text as H


def text_of(source):
    return "\n".join(H.read_page(source)[0])


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two", "one\ntwo"),
        ("<article><h1>T &amp; t</h1><p><b>A.<br><p>B\n \t&nbsp;c&#8364;</article><footer>f</footer>", "T & t\nA.\nB c€"),
        ("<body><nav>n</nav><script>var a='</p>';</script><style>p{}</style><div>x<!-- y --></div></body>", "x"),
        ("<article><p>a<script>x</article>", "a"),
        ("<p>a<!-- never ends <p>b", "a"),
        ("<p>a</p><p title='>' class=\"q>\">b</p><div data-x=it's>c</div>", "a\nb\nc"),
        ("<p>1 < 2 &lt; 3 </ p> &copyx &am</p", "1 < 2 < 3 ©x &am"),
        ("<article><p>x</p><aside>y</aside><section class='comments'><article class=comment>z</article></section><form>q</form></article>", "x"),
        ("<div class='site-header'>h</div><div id=main-content><div class='adBox'>ad</div><p>t</p></div><div role=contentinfo>f</div>", "t"),
        ("<header>site</header><main><header><h1>T</h1></header><p>x</p></main>", "T\nx"),
        ("<div class='page-with-sidebar'><article>kept</article><div class=sidebar>s</div></div>", "kept"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table><dl><dt>t<dd>d</dl>", "a\nb\nc\n1\n2\n3\nt\nd"),
        ("<div hidden>a</div><div style='display: none'>b</div><div aria-hidden=true>c</div><pre> d\n  e</pre>", "d e"),
        ("<p>cut <a href='x", "cut"),
        ("</div></p><p>x</div>y</p>z", "xy\nz"),
        ("<noscript>a</noscript><textarea>b</textarea><title>c</title><svg>d</svg>e", "e"),
        ("a<hr>b<p></p><p> </p>c", "a\nb\nc"),
        ("<" * 5000 + "a", "<" * 4999),
        ("<b>" * 20_000 + "deep" + "</b>" * 20_000, "deep"),
        ("<div>" * 20_000 + "deep", "deep"),
    ],
)
def test_one_page(source, want):
    assert text_of(source) == want


def pages(n=40):
    """One site with undeclared parts on many pages, each with an article of its own; half of the articles share a paragraph."""
    out = []
    for k in range(n):
        menu, other = f"<div><p>Home | News {k % 3}</p></div>", f"<div><p>of page {k} alone</p></div>"
        article = f"<h1>Title {k}</h1><p>Article {k} goes on for a while.</p>" + ("<p>The.</p>" if k % 2 else "") + "<div class=x>Read more below</div>"
        out.append((k, f"http://www.site.example/{k}", f"<body>{menu}<article>{article}</article>{other}<div>© all rights</div></body>"))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.row.page_id: r for r in H.extract_text(df, **options).collect()}


def test_undeclared_template_goes_by_its_count(spark):
    bare = [(i, u, h.replace("<article>", "<span>").replace("</article>", "</span>").replace("<h1>", "<p>").replace("</h1>", "</p>")) for i, u, h in pages()]
    got = run(spark, bare, ratio=0.2)
    for k in range(40):
        assert got[k].text == f"Title {k}\nArticle {k} goes on for a while.\nof page {k} alone"  # "The." of half the pages goes as well: nothing declares an article
        assert got[k].n_template >= 2 and got[k].n_declared == 0
    few = run(spark, bare[:2], ratio=0.2)
    assert "all rights" in few[0].text


def test_articles_keep_their_paragraphs_and_lose_containers(spark):
    got = run(spark, pages())
    for k in range(40):
        assert got[k].text == f"Title {k}\nArticle {k} goes on for a while." + ("\nThe." if k % 2 else "")


def test_copies_are_no_template(spark):
    rows = [(k, "http://a.example/", "<div><div>First part.</div><div>Second part.</div><div>Third part is long.</div></div>") for k in range(50)]
    got = run(spark, rows)
    assert {r.text for r in got.values()} == {"First part.\nSecond part.\nThird part is long."} and {r.n_template for r in got.values()} == {0}


def test_both_ways_of_joining_and_ratio(spark):
    rows = pages() + [(100 + k, None, h) for k, _, h in pages(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    plain = df.selectExpr("struct(page_id) AS row", "coalesce(parse_url(url, 'HOST'), '') AS host", "html")
    templates = H.site_templates(plain)
    read = plain.mapInArrow(H._reader, "row struct<page_id:bigint>, host string, blocks array<string>, subtrees array<struct<h:bigint,lo:int,hi:int>>, n_declared bigint")
    found = [sorted(map(tuple, H.delete_templates(read, templates, most).select("row.page_id", "text", "n_template").collect())) for most in (200_000, 0)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert run(spark, rows, ratio=1.0)[0].n_template == 0


def test_counts_equal_plain_counts(spark):
    rows = pages(12) * 2
    got = {(r.host, h) for r in H.site_templates(spark.createDataFrame([("h", x) for *_, x in rows], "host string, html string"), 0.3, 3).collect() for h in r.hashes}
    seen = {}
    for *_, x in rows:
        _, subtrees, content, _ = H.read_page(x)
        for h, _, _ in subtrees:
            seen.setdefault(h, set()).add(content)
    assert got == {("h", h) for h, c in seen.items() if len(c) >= 3 and len(c) > 0.3 * 12} and got


def test_odd_pages(spark, tmp_path):
    long = "<article>" + "".join(f"<p>par {k} &eacute;</p>" for k in range(60_000)) + "</article>"
    rows = [(1, None, None, "c"), (2, "", "", "c"), (3, "x", long, "c"), (3, "x", long, "c"), (None, "http://h", "<p>a", "c"), (5, "http://h", "<p> </p>\x00", "c")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, blocks string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in H.op11_html_text(spark, str(tmp_path)).collect()}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[None].text == "a"
    assert got[3].text == "\n".join(f"par {k} é" for k in range(60_000)) and got[3].n_chars == len(got[3].text)
    assert H.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
