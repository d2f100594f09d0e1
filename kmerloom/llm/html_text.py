"""Main text of web pages by removal of site templates.

*Pages.* Each page is read once into its blocks of text, in page order, and its subtrees: for each block-level element a
64-bit hash of its tags and text (attributes aside) and the range of blocks that it covers.

*Templates.* Spark counts the hashes of each host: in how many of the host's pages of different content a subtree occurs. Subtrees on more than
``ratio`` of these, and on ``LEAST`` at least, are the site's template and are deleted. Copies of one page are one content, so that a
page that is published many times does not become a template.

*What may be deleted.* Outside the article every block-level element; within it only containers (``div``, ``section``,
``nav`` ...), so that a short paragraph that many articles have is kept; never a subtree with at least half of the
page's own text. The article is the ``article`` elements of a page, else ``main``, else the elements that are named as the text's body, else the whole body.

*Declared parts.* A host with few pages shows no template. What a page itself declares to be no article goes too: ``nav``,
``aside``, ``footer``, forms, scripts, hidden parts, a ``header`` outside the article, roles such as ``banner``, classes and ids with words such as ``menu`` or
``comments`` (unless an ``article`` or ``main`` is inside).

Scale. Subtree hashes are 64-bit numbers, counted after one row for each (host, hash, content); a host has at most ``mean subtrees of a
page / ratio`` template hashes. That table is stored and broadcast if small, else joined by (host, salt), so that a host with a third of all
pages is dealt out. Pages are read twice and are never shuffled in the first case.

Defined results: null and empty pages give the empty text; pages without a host count as one host; a page of any length is read whole; unclosed elements end where their
parent ends, an unclosed comment, script or tag at the end of the page; equal pages give equal rows; ties cannot occur, as all subtrees above the ratio go;
other columns are kept as they are. An empty table gives an empty table. White space is what Unicode calls so; ``br`` is white space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm._common import lean_batches, stored, table
from kmerloom.llm.line_dedup import url_host

RATIO = 0.005
LEAST = 3
SALTS = 64

#: Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
CONTAINERS = frozenset("article aside details dialog div fieldset footer form header hgroup main menu nav search section".split())
LEAVES = frozenset("address blockquote caption center dd dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
BLOCKS = CONTAINERS | LEAVES | {"html", "head", "body", "hr"}
#: What a start tag closes, up to the nearest of the second set.
LISTS = frozenset("ul ol menu dir".split())
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

#: Parts that are declared to be no article.
NOT_TEXT = frozenset("nav aside footer form head menu search dialog button select datalist template object svg math canvas audio video noscript".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar status".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
BODY_NAMES = frozenset("articlebody entry-content post-content article-content article-body post-body story-body main-content".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

#: Kinds of elements: what their text is taken for.
TEXT, DECLARED, ARTICLE, MAIN, NAMED, HEADER = range(6)


def _kind(name: str, attributes: str) -> tuple[int, bool]:
    """The kind of an element by its name and attributes, and whether only its class or id says so."""
    if name in NOT_TEXT:
        return DECLARED, False
    found, loose = TEXT, False
    if name == "article":
        found = ARTICLE
    elif name == "main":
        found = MAIN
    if not attributes or attributes.isspace():
        return found, False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(a or b or c)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDES.search(value)):
            return DECLARED, False
        if key == "role":
            if value.lower() in ROLES:
                return DECLARED, False
            if value.lower() == "main" and found == TEXT:
                found = MAIN
        elif key in ("class", "id", "itemprop"):
            words = value.split()
            parts = {p.lower() for w in words for p in _NAME_PART.findall(w)}
            if parts & NAMES:
                loose = True
            elif "header" in parts and found == TEXT:
                found = HEADER
            elif found == TEXT and any(w.lower().replace("_", "-") in BODY_NAMES for w in words):
                found = NAMED
    # ``main`` and ``body`` hold the article whatever their classes are; an ``article`` may be a comment
    if loose and name not in ("main", "body", "html") and found != MAIN:
        return DECLARED, True
    return found, False


def _hash(parts: list[bytes]) -> bytes:
    return blake2b(b"\0".join(parts), digest_size=8).digest()


class Element:
    """A block-level element: its kind, the range of blocks that it covers, the hash of its tags and text."""

    __slots__ = ("name", "kind", "loose", "in_article", "has_article", "first", "end", "parts", "digest")

    def __init__(self, name: str, kind: int, loose: bool, in_article: bool, first: int):
        self.name, self.kind, self.loose, self.in_article, self.first = name, kind, loose, in_article, first
        self.has_article = False
        self.parts = [name.encode("utf-8", "replace")]

    def declared(self) -> bool:
        """Whether it is declared to be no article: a class is not believed around an article, nor a header in one."""
        if self.kind == DECLARED:
            return not (self.loose and self.has_article)
        return (self.name == "header" or self.kind == HEADER) and not self.in_article and not self.has_article


class Page:
    """``blocks``, the texts of one page in order, and ``elements`` with text, in the order in which they end."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.elements: list[Element] = []
        self._run: list[str] = []
        self._open = [Element("", TEXT, False, False, 0)]
        self._count: dict[str, int] = {}
        self._articles = 0
        self._read(source)

    def _flush(self) -> None:
        if self._run:
            text = "".join(self._run)
            self._run.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append(text)
                self._open[-1].parts.append(text.encode("utf-8", "replace"))

    def _start(self, name: str, attributes: str) -> None:
        e = Element(name, *_kind(name, attributes), self._articles > 0, len(self.blocks))
        self._articles += e.kind in (ARTICLE, MAIN)
        self._open.append(e)
        self._count[name] = self._count.get(name, 0) + 1

    def _end(self) -> None:
        self._flush()
        e = self._open.pop()
        self._articles -= e.kind in (ARTICLE, MAIN)
        self._count[e.name] -= 1
        e.end = len(self.blocks)
        if e.first < e.end:
            e.digest = _hash(e.parts)
            e.parts = []
            self._open[-1].parts.append(e.digest)
            self._open[-1].has_article |= e.has_article or e.kind in (ARTICLE, MAIN)
            self.elements.append(e)

    def _close(self, name: str) -> None:
        """Ends the innermost open element of that name, and all within it."""
        if self._count.get(name, 0):
            while self._open[-1].name != name:
                self._end()
            self._end()

    def _implied(self, name: str) -> None:
        """Ends what the start of a block of that name ends."""
        if name in BLOCKS and self._open[-1].name == "p":
            self._end()
        ends, within = CLOSES.get(name, ((), ()))
        if any(self._count.get(e, 0) for e in ends):
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k].name in ends:
                    while len(self._open) > k:
                        self._end()
                    return
                if self._open[k].name in within:
                    return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self._run.append(source[at:])
                break
            if m.start() > at:
                self._run.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            kept = name in BLOCKS or name in NOT_TEXT
            if m[1]:
                if kept and (self._count.get(name, 0) or name == "p"):  # a stray end tag is nothing, but </p> an empty paragraph
                    self._flush()
                    self._close(name)
            elif name in RAW:
                end = _RAW_END[name].search(source, at)
                at = end.start() if end else n
            elif name == "br":
                self._run.append(" ")
            elif kept:
                self._flush()
                self._implied(name)
                if name not in VOID:
                    self._start(name, m[3])
        while len(self._open) > 1:
            self._end()
        self._flush()


def _marked(elements: list[Element], n: int) -> np.ndarray:
    """Which blocks the elements cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [e.first for e in elements], 1)
    np.add.at(edge, [e.end for e in elements], -1)
    return np.cumsum(edge)[:n] > 0


def read_page(source: str) -> tuple[list[str], list[tuple[int, int, int]], int, int]:
    """The article's blocks without declared parts, and the subtrees (hash, first block, end block) that may be templates of the site; a hash of the blocks; how many declared parts hold text."""
    page = Page(source)
    n = len(page.blocks)
    declared = [e for e in page.elements if e.declared()]
    gone = _marked(declared, n)
    own = ~gone
    declares = False
    for wanted in (ARTICLE, MAIN, NAMED):
        parts = [e for e in page.elements if e.kind == wanted and not gone[e.first : e.end].all()]
        if parts:
            own &= _marked(parts, n)
            declares = True
            break
    size = np.concatenate([[0], np.cumsum([len(t) if mine else 0 for t, mine in zip(page.blocks, own)])]).tolist()
    place = np.concatenate([[0], np.cumsum(own)]).tolist()
    subtrees = []
    for e in page.elements:
        held = size[e.end] - size[e.first]
        if e.name in ("html", "body", "head") or (held and 2 * held >= size[-1]) or (held and declares and e.name in LEAVES):
            continue
        subtrees.append((int.from_bytes(e.digest, "big", signed=True), place[e.first], place[e.end]))
    blocks = [t for t, mine in zip(page.blocks, own) if mine]
    content = _hash([t.encode("utf-8", "replace") for t in blocks])
    return blocks, subtrees, int.from_bytes(content, "big", signed=True), len(declared)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns row, host, blocks, subtrees, n_declared of the columns row, host, html."""
    for batch in batches:
        read = [read_page(x or "") for x in batch.column("html").to_pylist()]
        blocks = pa.array([r[0] for r in read], pa.list_(pa.string()))
        flat = np.array([t for r in read for t in r[1]], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in read])]).astype(np.int32)
        parts = [pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))]
        subtrees = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["h", "lo", "hi"]))
        declared = pa.array([r[3] for r in read], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), blocks, subtrees, declared], ["row", "host", "blocks", "subtrees", "n_declared"])


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, h, content): each subtree of a page once, and a row without hash for the page itself."""
    for batch in batches:
        rows, hashes, contents = [], [], []
        for k, source in enumerate(batch.column("html").to_pylist()):
            _, subtrees, content, _ = read_page(source or "")
            own = [None, *{h for h, _, _ in subtrees}]
            rows += [k] * len(own)
            hashes += own
            contents += [content] * len(own)
        yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(rows, pa.int64())), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], ["host", "h", "content"])


def site_templates(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, hashes array<bigint>): the subtrees on more than ``ratio`` of a host's pages of different content, from (host, html)."""
    seen = pages.select("host", "html").mapInArrow(_hasher, "host string, h bigint, content bigint").distinct()
    counted = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted.where((F.col("n") >= least) | F.col("h").isNull()), "html-subtrees")
    per_host = counted.where("h is null").select("host", F.col("n").alias("n_host"))
    often = counted.where("h is not null").join(per_host, "host").where(F.col("n") > F.lit(ratio) * F.col("n_host"))
    return often.groupBy("host").agg(F.collect_list("h").alias("hashes"))


def delete_templates(read: DataFrame, templates: DataFrame, most_hashes: int = 200_000) -> DataFrame:
    """Columns row, text, n_chars, n_template, n_declared of read pages."""
    n = templates.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]
    if n <= most_hashes:
        joined = read.join(F.broadcast(templates), "host", "left")
    else:
        dealt = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = read.withColumn("salt", F.pmod(F.xxhash64("blocks"), F.lit(SALTS))).join(dealt, ["host", "salt"], "left")
    own = F.array_intersect(F.transform("subtrees", lambda s: s["h"]), F.col("hashes"))
    hits = joined.withColumn("own", F.coalesce(own, F.array().cast("array<bigint>")))
    hits = hits.withColumn("hits", F.filter("subtrees", lambda s: F.array_contains(F.col("own"), s["h"])))
    # only hits with blocks of the article change its text
    cuts = F.filter("hits", lambda s: s["lo"] < s["hi"])
    hits = hits.withColumn("cuts", cuts)
    kept = F.when(F.size("cuts") == 0, F.col("blocks")).otherwise(F.filter("blocks", lambda b, k: ~F.exists("cuts", lambda s: (s["lo"] <= k) & (k < s["hi"]))))
    out = hits.select("row", F.array_join(kept, "\n").alias("text"), F.size("hits").cast("bigint").alias("n_template"), "n_declared")
    return out.select("row", "text", F.length("text").cast("bigint").alias("n_chars"), "n_template", "n_declared")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Columns row (all columns of the page, or those in ``keep``), text, n_chars, n_template, n_declared; one row per page.

    n_template: the subtrees that are deleted as the site's template; n_declared: the parts that the page declares to be no article.
    """
    kept = F.struct(*[F.col(c) for c in keep or pages.columns])
    plain = pages.select(kept.alias("row"), F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    templates = stored(site_templates(plain, ratio, least), "html-templates")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select("row", "host").schema)
    kind = f"{fields}, blocks array<string>, subtrees array<struct<h:bigint,lo:int,hi:int>>, n_declared bigint"
    return delete_templates(plain.mapInArrow(_reader, kind), templates)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    out = extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars", "n_template", "n_declared")
