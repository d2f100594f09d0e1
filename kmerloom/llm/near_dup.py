"""MinHash near-dedup: chosen-path set similarity join.

A document's set holds its distinct word shingles (64-bit hashes). Equal sets are one class, found by a
128-bit digest, and only the class goes on. A class is known by a number of its own (half of the digest, or a
hash of the whole where that half is not unique), never by a doc_id, so that documents that share an id stay apart.

*Trees.* A representative has 128 minwise tokens. An independent tree starts at a seed; a node at
level ``l`` picks ``branches[l]`` of the 128 coordinates by hashing its path, and a document goes on to
the child named by the picked coordinate and its token there. Which coordinates a node picks depends on
the path alone, so documents walk their trees without meeting. A pair of similarity ``s`` survives a tree
with probability f(0), f(l) = 1 - (1 - s f(l + 1)) ** branches[l], f(last) = 1; trees repeat until the pair
at the threshold is missed with at most ``1 - recall``, averaged over how many of the 128 tokens, which all trees
share, the pair has in common. The number of levels grows with the number of documents, so that nodes of unrelated
documents stay small.

*Nodes.* Members of a node are compared by 128-bit sketches (one bit of each minwise token); pairs that differ in so
many bits as a pair at the threshold does with a tenth of ``1 - recall`` at most are left out. In the first round, a
member of a node of up to ``small_node`` members is paired with the first member that it may be linked
with; in a larger node, with the nearest of 64 pivots, while the node streams by in bounded memory.
Full sets decide these pairs, and their links give components.

*Second round.* Nodes with further possible pairs are looked at again with the components known: each
member outside the node's main component meets all members of other components. Odd sketches (parities of hashed
set members) bound the symmetric difference from below without error, so only pairs whose sets can
still be similar enough are tested on full sets. So every possible pair of a node is either decided or lies inside
one component, and no group of alike documents ever emits all its pairs.

Defined results: null and empty texts, and texts without words, have the empty set, are linked with nothing
and are kept; fewer words than a shingle has make one shingle; rows that repeat a doc_id are judged each by its own
text; a null doc_id comes after all others and has the component of its set's class. Very long texts are whole sets like any other. In
``near_duplicates`` a row is kept if its doc_id is its component's; ``drop_near_duplicates`` judges by row: of
each component the row with the least (doc_id, hashes of the text) stays, once if it is repeated. Extra columns are
never looked at and pass through. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _text as T
from kmerloom.llm._common import kept, lean_batches, partitions, small, stored, table
from kmerloom.llm.graph import components

TOKENS = 128
PIVOTS = 64
ODD_WORDS = 16
_seeds = np.random.Generator(np.random.PCG64(77))
TOKEN_MUL = _seeds.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * T.U64(2) + T.U64(1)
TOKEN_ADD = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each begins."""
    n_docs = len(offsets) - 1
    data = T.LOWER[data]
    starts, ends, doc = T.words(data, offsets, T.NON_SPACE)
    h = T.word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count

    def combine(at: np.ndarray, length: int) -> np.ndarray:
        x = np.full(len(at), length, np.uint64)
        for k in range(length):
            x = T.mix(x * T.U64(0x9FB21C651E98DF25) + h[at + k])
        return x

    left = first[doc] + count[doc] - np.arange(len(doc))  # words from here to the document's end
    at = np.flatnonzero(left >= width)
    sh, owner = combine(at, width), doc[at]
    short = np.flatnonzero((count > 0) & (count < width))
    for length in np.unique(count[short]):
        own = short[count[short] == length]
        sh, owner = np.concatenate([sh, combine(first[own], int(length))]), np.concatenate([owner, own])
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    sh, owner = sh[new], owner[new]
    return sh, np.searchsorted(owner, np.arange(n_docs + 1))


def minwise(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(documents, TOKENS) minwise tokens of non-empty sets."""
    out = np.empty((len(begin), TOKENS), np.uint64)
    if len(begin):
        for t in range(TOKENS):
            out[:, t] = np.minimum.reduceat(sets * TOKEN_MUL[t] + TOKEN_ADD[t], begin)
    return T.mix(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """(documents, 2) words of 64 sketch bits."""
    bits = (T.mix(tokens ^ T.U64(0x5851F42D4C957F2D)) & T.U64(1)) << np.tile(np.arange(64, dtype=np.uint64), 2)[None, :]
    return np.stack([np.bitwise_or.reduce(bits[:, :64], 1), np.bitwise_or.reduce(bits[:, 64:], 1)], 1)


def odd_sketch(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(documents, ODD_WORDS) words: bit b is the parity of the number of members that hash to b."""
    n = len(begin) - 1
    bit = (T.mix(sets ^ T.U64(0x1F83D9ABFB41BD6B)) >> T.U64(64 - (ODD_WORDS * 64).bit_length() + 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(begin)) * (ODD_WORDS * 64) + bit, minlength=n * ODD_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(n, ODD_WORDS)


def paths(tokens: np.ndarray, trees: int, branches: tuple[int, ...]) -> np.ndarray:
    """(documents, leaves) node hashes at the last level of each document's trees."""
    n = len(tokens)
    node = np.broadcast_to(T.mix(np.arange(1, trees + 1, dtype=np.uint64)), (n, trees))
    rows = np.arange(n)[:, None]
    for level, b in enumerate(branches):
        children = []
        for k in range(b):
            pick = T.mix(node + T.U64(level * 64 + k + 1))
            coordinate = (pick >> T.U64(57)).astype(np.int64)
            children.append(T.mix(pick ^ (tokens[rows, coordinate] * T.U64(0xAEF17502108EF2D9))))
        node = np.concatenate(children, 1)
    return node


def plan_trees(n_docs: int, similarity: float, recall: float) -> tuple[int, tuple[int, ...]]:
    """Number of trees and branches of each level: four levels up to 10 million documents, one more for each 20-fold.

    Nine tenths of what may be missed are the trees'.
    """
    levels = 4 + max(0, math.ceil(math.log(max(1, n_docs) / 1e7) / math.log(20)))
    branches = tuple(2 if k % 2 == 0 else 1 for k in range(levels))

    def survives(s: float) -> float:
        alive = 1.0
        for b in reversed(branches):
            alive = 1 - (1 - s * alive) ** b
        return alive

    shared = _binomial(TOKENS, similarity)
    trees = 1
    while sum(p * (1 - survives(k / TOKENS)) ** trees for k, p in enumerate(shared)) > 0.9 * (1 - recall):
        trees += 1
    return trees, branches


def _binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def _profiler(width: int, trees: int, branches: tuple[int, ...]):
    leaves = trees * math.prod(branches)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for i, j in T.runs(offsets):
                sets, begin = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                digest = np.zeros((j - i, 2), np.uint64)
                keys, sk = np.zeros((len(full), leaves), np.uint64), np.zeros((j - i, 2), np.uint64)
                if len(full):
                    at = begin[:-1][full]
                    digest[full, 0] = T.mix(np.add.reduceat(T.mix(sets), at) + n[full].astype(np.uint64))
                    digest[full, 1] = np.add.reduceat(T.mix(sets ^ T.U64(0x2545F4914F6CDD1D)), at)
                    tokens = minwise(sets, at)
                    keys, sk[full] = paths(tokens, trees, branches), sketch(tokens)
                sizes = np.where(n > 0, leaves, 0)
                key_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _i64(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(i, j - i) for k in ("doc_id", "h1", "h2")], pa.array(n.astype(np.int64)), *[_i64(np.ascontiguousarray(x)) for x in (digest[:, 0], digest[:, 1], sk[:, 0], sk[:, 1])], key_lists],
                    ["doc_id", "h1", "h2", "n_shingles", "d1", "d2", "s1", "s2", "keys"],
                )

    return profile


def _sketch_limit(similarity: float, recall: float) -> int:
    """Most differing sketch bits of a pair that may be linked: at the threshold, more differ with a tenth of ``1 - recall`` at most."""
    differ = _binomial(TOKENS, (1 - similarity) / 2)
    return next(k for k in range(TOKENS + 1) if sum(differ[k + 1 :]) <= 0.1 * (1 - recall))


def _comparer(limit: int, small_node: int):
    """Streams rows (key, rep, s1, s2) in order of key and rep.

    Gives first-round pairs (a, b), and as rows (key, rep, s1, s2) the members of nodes with more possible pairs.
    """

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int64) + np.bitwise_count(x[..., 1] ^ y[..., 1])

    def result(pairs: list, again: list) -> pa.RecordBatch:
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        members = [np.concatenate([m[k] for m in again]) if again else np.zeros(0, np.int64) for k in range(4)]
        head = [pa.concat_arrays([pa.array(x), pa.nulls(len(members[0]), pa.int64())]) for x in (a, b)]
        tail = [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(m)]) for m in members]
        return pa.RecordBatch.from_arrays([*head, *tail], ["a", "b", "key", "rep", "s1", "s2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        pivots = None  # of the large node that goes on: key, reps, sketches
        for batch in _and_end(batches):
            pairs, again = [], []
            cols = held if batch is None else [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            if pivots is not None and len(cols[0]):
                stop = int(np.searchsorted(cols[0], pivots[0], "right"))
                more = [c[:stop] for c in cols]
                cols = [c[stop:] for c in cols]
                against(pairs, pivots[1], pivots[2], more)
                again.append(more)
                if len(cols[0]):
                    pivots = None
            key = cols[0]
            done = len(key) if batch is None or not len(key) else int(np.searchsorted(key, key[-1]))
            if len(key) - done > small_node:  # the last node is large already
                done = len(key)
            now, held = [c[:done] for c in cols], [c[done:] for c in cols]
            if done:
                begin = np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))
                size = np.diff(np.concatenate([begin, [done]]))
                sk = np.stack(now[2:], 1).view(np.uint64)
                for s, m in zip(begin[size > small_node], size[size > small_node]):
                    node = [c[s : s + m] for c in now]
                    against(pairs, node[1][:PIVOTS], sk[s : s + PIVOTS], node)
                    again.append(node)
                    if s + m == done and batch is not None and not len(held[0]):
                        pivots = (node[0][0], node[1][:PIVOTS].copy(), sk[s : s + PIVOTS].copy())
                in_small(pairs, again, now, sk, begin, size)
            yield result(pairs, again)

    def against(pairs: list, reps: np.ndarray, sketches: np.ndarray, node: list) -> None:
        """Each member with its nearest pivot."""
        sk = np.stack(node[2:], 1).view(np.uint64)
        best, away = np.zeros(len(sk), np.int64), np.full(len(sk), limit + 1)
        for rep, own in zip(reps, sketches):
            d = np.where(node[1] == rep, limit + 1, apart(sk, own))
            nearer = d < away
            best[nearer], away[nearer] = rep, d[nearer]
        ok = away <= limit
        pairs.append((best[ok], node[1][ok]))

    def in_small(pairs: list, again: list, now: list, sk: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        rep, place = now[1], np.arange(len(now[0])) - np.repeat(begin, size)
        node = np.repeat(np.arange(len(begin)), size)
        fits = (size > 1) & (size <= small_node)
        candidates = np.flatnonzero(fits[node])
        met, more = np.zeros(len(rep), bool), np.zeros(len(begin), bool)
        for d in range(int(size[fits].max(initial=1)) - 1, 0, -1):  # far partners first: they stand first in their node
            j = candidates[place[candidates] >= d]
            j = j[(apart(sk[j], sk[j - d]) <= limit) & (rep[j] != rep[j - d])]
            new = j[~met[j]]
            more[node[j[met[j]]]] = True
            met[new] = True
            if len(new):
                pairs.append((rep[new - d], rep[new]))
        if more.any():
            own = more[node]
            again.append([c[own] for c in now])

    return compare


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _set_writer(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for i, j in T.runs(offsets):
                found, begin = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((begin * 8).astype(np.int64)), pa.py_buffer(found)]).cast(pa.binary())
                odd = pa.FixedSizeListArray.from_arrays(_i64(odd_sketch(found, begin).ravel()), ODD_WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), blobs, pa.array(np.diff(begin)), odd], ["rep", "members", "n", "odd"])

    return sets


def _tester(percent: int):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (ma, mb) in enumerate(zip(batch.column("ma"), batch.column("mb"))):
                x, y = np.frombuffer(ma.as_buffer(), np.uint64), np.frombuffer(mb.as_buffer(), np.uint64)
                lesser, greater = min(len(x), len(y)), max(len(x), len(y))
                if 100 * lesser < percent * greater:
                    continue
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                good[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return test


def _between_components(again: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Stored second-round pairs (a, b): members of one node, in different components, that may be linked."""
    named = again.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = stored(named, "near-again")
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = stored(sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main"), "near-split")
    whole = named.join(split, "key").join(sets.select("rep", F.col("n").alias("size"), "odd"), "rep")
    whole = stored(whole, "near-again-sets")
    x = whole.where("component <> main").select(F.col("key").alias("kx"), *[F.col(c).alias(f"{c}_x") for c in ("rep", "component", "s1", "s2", "size", "odd")])
    total = F.col("size") + F.col("size_x")
    differ = F.aggregate(F.zip_with("odd", "odd_x", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda m, n: m + n)
    # similar sets differ in at most total * (100 - percent) / (100 + percent) members
    may = (F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_x"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_x"))) <= limit) & (differ * (100 + percent) <= total * (100 - percent))
    met = whole.join(x, (F.col("key") == F.col("kx")) & (F.col("component") != F.col("component_x")) & may)
    return stored(met.select(F.least("rep", "rep_x").alias("a"), F.greatest("rep", "rep_x").alias("b")).distinct(), "near-left")


ROW = ("doc_id", "h1", "h2")


def _same_row(x: DataFrame, y: DataFrame) -> Column:
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: doc_id and 128 bits of hashes of the text."""
    return [F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2")]


def decide(docs: DataFrame, width: int = 5, percent: int = 80, recall: float = 0.99999, small_node: int = 64, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, h1, h2, n_shingles, lead): ``lead`` (no_id, doc_id, h1, h2) is its component's first row, null for empty sets.

    And, stored, the rows (doc_id, h1, h2) that occur more than once.
    """
    spark = docs.sparkSession
    plain = docs.select(*_row_keys(id_col, text_col), F.col(text_col).alias("text"))
    trees, branches = plan_trees(plain.select("doc_id").count(), percent / 100, recall)
    limit = _sketch_limit(percent / 100, recall)
    schema = "doc_id bigint, h1 bigint, h2 bigint, n_shingles bigint, d1 bigint, d2 bigint, s1 bigint, s2 bigint, keys array<bigint>"
    profiles = kept(plain.mapInArrow(_profiler(width, trees, branches), schema))
    repeated = stored(profiles.groupBy(*ROW).count().where("count > 1").drop("count"), "near-repeated")
    some_repeat = not repeated.isEmpty()

    full = profiles.where("n_shingles > 0")
    clash = stored(full.groupBy("d1").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi")).where("lo <> hi").select("d1", F.lit(True).alias("clash")), "near-clash")
    if clash.isEmpty():
        full = full.withColumn("rep", F.col("d1"))
    else:
        full = full.join(small(clash)(clash), "d1", "left").withColumn("rep", F.when(F.col("clash"), F.xxhash64("d1", "d2")).otherwise(F.col("d1")))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW)
    classes = full.groupBy("rep").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.first("keys").alias("keys"))
    leads = stored(full.select("rep", row.alias("row")).groupBy("rep").agg(F.min("row").alias("lead")), "near-leads")

    nodes = classes.select(F.explode("keys").alias("key"), "rep", "s1", "s2")
    n = max(partitions(spark), spark.sparkContext.defaultParallelism)
    ordered = nodes.repartition(n, "key").sortWithinPartitions("key", "rep")
    compared = kept(ordered.mapInArrow(_comparer(limit, small_node), "a bigint, b bigint, key bigint, rep bigint, s1 bigint, s2 bigint"))
    pairs = compared.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    again = compared.where("rep is not null").select("key", "rep", "s1", "s2")
    involved = compared.select(F.explode(F.array("a", "b", "rep")).alias("rep")).where("rep is not null").distinct().join(leads, "rep").select("rep", "lead.doc_id", "lead.h1", "lead.h2")
    involved = stored(involved, "near-involved")
    texts = plain.join(small(involved, 1_000_000)(involved), _same_row(plain, involved)).select("rep", "text")
    if some_repeat:
        texts = texts.dropDuplicates(["rep"])
    sets = kept(texts.mapInArrow(_set_writer(width), "rep bigint, members binary, n bigint, odd array<bigint>"))

    def tested(candidates: DataFrame) -> DataFrame:
        """Stored pairs whose full sets are similar enough."""
        both = candidates.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a")
        links = both.select("a", "b", "ma", "mb").mapInArrow(_tester(percent), "a bigint, b bigint")
        return stored(links.hint("rebalance"), "near-links")

    links = tested(pairs)
    parts = components(links)
    left = _between_components(again, parts, sets, percent, limit)
    if not left.isEmpty():
        parts = components(links.union(tested(left)))

    linked = parts.select(F.col("id").alias("rep"), "component").join(leads, "rep")
    first = linked.groupBy("component").agg(F.min("lead").alias("first"))
    named = linked.select("rep", "component").join(first, "component").select("rep", "first")
    named = stored(leads.join(named, "rep", "left").select("rep", F.coalesce("first", "lead").alias("lead")), "near-classes")
    found = full.select(*ROW, "n_shingles", "rep").join(named, "rep", "left").select(*ROW, "n_shingles", "lead")
    empty = profiles.where("n_shingles = 0").select(*ROW, "n_shingles", F.lit(None).cast(found.schema["lead"].dataType).alias("lead"))
    return found.union(empty), repeated


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept. Options: see :func:`decide`."""
    rows, _ = decide(docs, **options)
    component = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row left of each component; all columns stay."""
    rows, repeated = decide(docs, id_col=id_col, text_col=text_col, **options)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW)
    gone = rows.where(F.col("lead").isNotNull() & (F.col("lead") != own)).select(*ROW).distinct()
    full = rows.where(F.col("lead").isNotNull() & (F.col("lead") == own)).select(*ROW)
    once = None
    if not repeated.isEmpty():
        once = stored(repeated.join(full.distinct(), _same_row(repeated, full), "left_semi"), "near-once")
        gone = gone.union(once)
    gone = stored(gone, "near-gone")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("document"), *_row_keys(id_col, text_col))
    left = keyed.join(small(gone, 1_000_000)(gone), _same_row(keyed, gone), "left_anti").select("document")
    if once is not None:
        twice = keyed.join(once, _same_row(keyed, once), "left_semi")
        left = left.union(twice.groupBy(*ROW).agg(F.min_by("document", F.xxhash64("document")).alias("document")).select("document"))
    return left.select("document.*")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP10_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
f AS MATERIALIZED (SELECT g, count(*) AS df FROM s GROUP BY g),
o AS MATERIALIZED (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS place FROM s JOIN f USING (g) JOIN n USING (doc_id)),
prefix AS MATERIALIZED (SELECT doc_id, g, n FROM o WHERE place <= n - (n * 80 + 99) // 100 + 1),
pairs AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefix x JOIN prefix y USING (g) WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
inter AS MATERIALIZED (SELECT a, b, count(*) AS i FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
links AS MATERIALIZED (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.node = e.a),
c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
