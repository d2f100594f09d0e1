"""Suffix-array dedup: bytes covered by a string of 100 bytes that also starts earlier.

*Sparse suffixes.* Sorting the suffixes at all positions is not needed to find equal strings of ``length``
bytes. Each such window picks the position of its least 32-byte gram (leftmost on ties) as its anchor;
equal windows pick equal anchors, and successive windows share one, so about one suffix of 35 is kept. An
anchor stands for the run of windows that picked it; the bytes under that run are its context.

*Tokens and buckets.* A suffix is compared by tokens: the 64-bit hash of its gram, then the 128-bit BLAKE2 digest
of the bytes of its whole context, then (doc_id, row, position). Splitters of (gram, first half of the digest) come
from a bounded sample of documents; suffixes are range-partitioned by them into buckets of ``BUCKET_BYTES`` of text, so
that one frequent gram is cut into several buckets by its second token. Within a bucket, suffixes are put in order by
multikey quicksort (three-way partition by one token, equal runs by the next). Before they are sent, each task keeps
only the first of equal contexts.

*Runs.* Equal contexts after the first are removed with all their windows. If a gram has one context only, nothing is to
be done. The first of each context of a gram with several contexts is compared further. A gram at the
edge of a bucket may go on in the next bucket: its runs count as hot.

*Contexts.* The contexts left meet by gram, as bytes; their windows are put in order by the same multikey quicksort
and all but the first of equal windows are removed. Hot grams (more than ``hot`` contexts, or at a bucket's edge) send
each window by itself, keyed by the window's fingerprint, after equal windows within a task were
reduced to the first; so no group grows with the number of documents.

*Equality.* Whole contexts count as equal by their 128-bit digests. Windows that meet by hash are compared byte by
byte; different windows with equal hashes are told apart. Whole texts are used; matches never cross documents.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; equal rows (same doc_id and
text, the text by a 64-bit hash) are one document and get one result each; rows that share a doc_id with different
texts are ordered by that hash; a null doc_id comes before all others. Texts longer than ``PIECE`` are read in overlapping
pieces, with the same result. Empty tables give empty results; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _text as T
from kmerloom.llm._common import lean_batches, partitions, stored, table

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
FLUSH = 400_000
HOT = 4096
SAMPLE_DOCS = 3000
BUCKET_BYTES = 16 << 20
#: Suffixes in one blob of a shuffled row, and blobs in one batch: large values would stay in the heap for long.
BLOB, BLOBS = 4096, 16
_U = T.U64
_MIX = _U(0x85EBCA77C2B2AE63)
NULL_ID = -(1 << 63)


def multikey_quicksort(tokens: list[np.ndarray], cutoff: int = 4096) -> np.ndarray:
    """Order of rows by a list of token columns: three-way partition by one token, equal rows by the next one."""
    order = np.arange(len(tokens[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(tokens):
            continue
        part = order[lo:hi]
        if hi - lo <= cutoff:
            order[lo:hi] = part[np.lexsort([t[part] for t in tokens[depth:][::-1]])]
            continue
        values = tokens[depth][part]
        a, b, c = values[0], values[(hi - lo) // 2], values[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        less, equal = values < pivot, values == pivot
        i, j = lo + int(less.sum()), lo + int(less.sum()) + int(equal.sum())
        order[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        stack += [(lo, i, depth), (i, j, depth + 1), (j, hi, depth)]
    return order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def exact_runs(data: np.ndarray, at: np.ndarray, new: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and run starts of windows ``at``, given runs of equal hashes: a run with different bytes is taken apart."""
    rows = np.arange(len(at))
    first = np.maximum.accumulate(np.where(new, rows, 0))
    rest = np.flatnonzero(~new)
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else data.reshape(0, length)
    odd = [part[(view[at[part]] != view[at[first[part]]]).any(1)] for part in np.split(rest, range(1 << 14, len(rest), 1 << 14))]
    odd = np.concatenate(odd) if odd else rest
    if not len(odd):
        return rows, new
    code, seen = np.zeros(len(at), np.int64), {}
    for k in odd.tolist():
        code[k] = seen.setdefault((first[k], view[at[k]].tobytes()), len(seen) + 1)
    order = np.lexsort((rows, code, first))
    return order, _changes(first[order], code[order])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document of each part, its first position): documents together, long ones in overlapping pieces."""
    for i, j in T.runs(offsets, PIECE):
        lo, size = int(offsets[i]), int(offsets[j] - offsets[i])
        if size <= PIECE:
            yield data[lo : lo + size], offsets[i : j + 1] - lo, np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        for at in range(0, max(1, size - length + 1), PIECE):
            part = data[lo + at : lo + min(size, at + PIECE + length - 1)]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at])


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each place."""
    p = T.prefix_hash(data)
    _, down = T.powers(len(data))
    n = len(data) - gram + 1
    return T.mix((p[gram:] - p[:n]) * down[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """Anchors of all windows that lie within one part: part, start (first window), anchor, last (last window), gram and context (two halves) tokens."""
    n, width, none = len(data), length - gram + 1, None
    if n < length:
        return none
    h = _grams(data, gram)
    low = _U(PIECE.bit_length() + 1)
    ranked = ((h >> low) << low) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = ranked
    grid = padded.reshape(-1, width)
    after = np.minimum.accumulate(grid, 1).ravel()
    before = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n_windows = n - length + 1
    best = (np.minimum(before[:n_windows], after[width - 1 : width - 1 + n_windows]) & ((_U(1) << low) - _U(1))).astype(np.int64)
    crossing = np.zeros(n + 1, np.int64)
    edges = offsets[1:-1]
    np.add.at(crossing, np.maximum(edges - length + 1, 0), 1)
    np.add.at(crossing, edges, -1)
    window = np.flatnonzero(np.cumsum(crossing[:n_windows]) == 0)
    if not len(window):
        return none
    pick = best[window]
    first = np.flatnonzero(_changes(pick))
    last = window[np.concatenate([first[1:] - 1, [len(window) - 1]])]
    start, anchor = window[first], pick[first]
    raw = memoryview(np.ascontiguousarray(data))
    context = digests([raw[s:e] for s, e in zip(start.tolist(), (last + length).tolist())])
    return {"part": np.searchsorted(offsets, start, "right") - 1, "start": start, "anchor": anchor, "last": last, "gram": h[anchor], "c1": context[:, 0], "c2": context[:, 1]}


def digests(parts: list) -> np.ndarray:
    """(parts, 2) words of the 128-bit digests of byte strings."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.uint64).reshape(-1, 2)


FIELDS = ("gram", "c1", "c2", "id", "row", "at")


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of longs one after another; ids and rows as differences, which compress well."""
    parts = [c.view(np.int64) for c in columns]
    parts[3:5] = [np.diff(c, prepend=np.int64(0)) for c in parts[3:5]]
    return np.concatenate(parts).tobytes()


def _unpack(blob: bytes) -> list[np.ndarray]:
    grid = np.frombuffer(blob, np.int64).reshape(len(FIELDS), -1)
    return [*grid[:3].view(np.uint64), np.cumsum(grid[3]), np.cumsum(grid[4]), grid[5]]


def _at(start: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, offset of the anchor and number of further windows in one long."""
    return start << 14 | (anchor - start) << 7 | (last - start)


def _suffixes(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[list[np.ndarray]]:
    data, offsets = T.utf8(batch.column("text"))
    ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
    for part, edges, docs, firsts in pieces(data, offsets, length):
        found = anchors(part, edges, length, gram)
        if found is None:
            continue
        d = found["part"]
        shift = firsts[d] - edges[d]
        yield [found["gram"], found["c1"], found["c2"], ids[docs[d]], rows[docs[d]], _at(found["start"] + shift, found["anchor"] + shift, found["last"] + shift)]


def place(splitters: tuple[np.ndarray, np.ndarray], gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Bucket of each suffix: the number of splitters (gram, first half of the digest) that are not above it."""
    s_gram, s_context = splitters
    bucket = np.searchsorted(s_gram, gram, "left")
    near = np.minimum(bucket, max(0, len(s_gram) - 1))
    for value in np.unique(gram[s_gram[near] == gram]) if len(s_gram) else ():
        own = gram == value
        lo, hi = np.searchsorted(s_gram, value, "left"), np.searchsorted(s_gram, value, "right")
        bucket[own] = lo + np.searchsorted(s_context[lo:hi], context[own], "right")
    return bucket


EVENTS = "part int, id bigint, row bigint, kind int, s bigint, e bigint, blob binary"
EVENT_NAMES = [x.split()[0] for x in EVENTS.split(", ")]
REMOVED, CONTEXT, HOT_CONTEXT = 0, 1, 2


def _events(part: np.ndarray | int, ids: np.ndarray, row: np.ndarray, kind: np.ndarray | int, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    n = len(row)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n).copy())
    columns = [full(part, np.int32), pa.array(ids), pa.array(row), full(kind, np.int32), pa.array(s), pa.array(e), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, EVENT_NAMES)


def _span(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    start = at >> 14
    return start, start + (at & 127) + length


def _repeated(columns: list[np.ndarray], new: np.ndarray) -> np.ndarray:
    """Rows after the first of their run (``new`` starts a run) that are not the very same occurrence as the first."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = np.logical_and.reduce([c == c[first] for c in columns])
    return ~new & ~same


def _sender(splitters, n_parts: int, length: int, gram: int):
    """Suffixes of the documents by bucket, reduced to the first of equal contexts within the task."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not size:
                return
            cols = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            new = _changes(*cols[:3])
            again = _repeated(cols[3:], new)
            s, e = _span(cols[5][again], length)
            ids, row = cols[3][again], cols[4][again]
            yield _events((row % n_parts).astype(np.int32), ids, row, REMOVED, s, e)
            cols = [c[new] for c in cols]
            bucket = place(splitters.value, cols[0], cols[1])
            order = np.lexsort((cols[5], cols[4], cols[3], bucket))
            cols, bucket = [c[order] for c in cols], bucket[order]
            begin = np.flatnonzero(_changes(bucket))
            ends = np.append(begin[1:], len(bucket))
            cuts = [(k, min(k + BLOB, j)) for i, j in zip(begin.tolist(), ends.tolist()) for k in range(i, j, BLOB)]
            for at in range(0, len(cuts), BLOBS):
                own = cuts[at : at + BLOBS]
                n = len(own)
                parts = pa.array(bucket[[i for i, _ in own]].astype(np.int32))
                blobs = pa.array([_pack([c[i:j] for c in cols]) for i, j in own], pa.binary())
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([parts, nothing, nothing, pa.nulls(n, pa.int32()), nothing, nothing, blobs], EVENT_NAMES)
            held, size = [], 0

        for batch in batches:
            for cols in _suffixes(batch, length, gram):
                held.append(cols)
                size += len(cols[0])
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    return send


def _sorter(splitters, length: int, hot: int):
    """A bucket, which is a partition: multikey quicksort, then the runs of equal grams and contexts."""

    def bucket_runs(number: int, blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*blobs)]
        blobs.clear()
        order = multikey_quicksort(cols)
        cols = [c[order] for c in cols]
        gram, _, _, ids, row, at = cols
        new_gram, new = _changes(gram), _changes(*cols[:3])
        again = _repeated(cols[3:], new)
        s, e = _span(at[again], length)
        yield _events(number, ids[again], row[again], REMOVED, s, e)
        run = np.cumsum(new_gram) - 1
        contexts = np.bincount(run, new).astype(np.int64)[run]
        s_gram = splitters.value[0]
        edge = np.isin(gram, s_gram[max(0, number - 1) : number + 1])
        kept = new & ((contexts > 1) | edge)
        kind = np.where((contexts > hot) | edge, HOT_CONTEXT, CONTEXT)[kept]
        yield _events(number, ids[kept], row[kept], kind, at[kept], np.zeros(kept.sum(), np.int64))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blobs = 0, []
        for batch in batches:
            passed = batch.filter(batch.column("blob").is_null())
            if len(passed):
                yield passed
            rest = batch.filter(batch.column("blob").is_valid())
            if len(rest):
                number = rest.column("part")[0].as_py()
                blobs += [_unpack(blob.as_py()) for blob in rest.column("blob")]
        if blobs:
            yield from bucket_runs(number, blobs)

    return sort


CONTEXTS = "g bigint, id bigint, row bigint, start bigint, bytes binary, s bigint, e bigint"
CONTEXT_NAMES = [x.split()[0] for x in CONTEXTS.split(", ")]


def _contexts(length: int, gram: int):
    """Context bytes of the suffixes left, keyed by gram; of hot ones, each window keyed by its fingerprint."""

    def batch_of(g, ids, row, start, blobs) -> pa.RecordBatch:
        none = pa.nulls(len(g), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids), pa.array(row), pa.array(start), blobs, none, none], CONTEXT_NAMES)

    def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            ats = batch.column("ats").combine_chunks() if isinstance(batch.column("ats"), pa.ChunkedArray) else batch.column("ats")
            at = ats.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), np.asarray(ats.value_lengths()))
            hot_flag = at < 0
            at = np.where(hot_flag, ~at, at)
            base = offsets[doc]
            start, anchor = base + (at >> 14), base + (at >> 14) + (at >> 7 & 127)
            size = (at & 127) + length
            for i, j in T.runs(np.concatenate([[0], np.cumsum(size)]), PIECE) if len(at) else ():
                own, is_hot = slice(i, j), hot_flag[i:j]
                grams = T.mix(_hash_at(data, anchor[own], gram))
                plain = np.flatnonzero(~is_hot) + i
                if len(plain):
                    yield batch_of(grams[~is_hot], ids[doc[plain]], rows[doc[plain]], start[plain] - base[plain], cut(data, start[plain], size[plain]))
                warm = np.flatnonzero(is_hot) + i
                if len(warm):
                    n = size[warm] - length + 1
                    window = np.repeat(start[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    owner = np.repeat(doc[warm], n)
                    key = T.mix(_hash_at(data, window, length) ^ _MIX)
                    order = np.lexsort((window - offsets[owner], rows[owner], ids[owner], key))
                    window, owner, key = window[order], owner[order], key[order]
                    order, new = exact_runs(data, window, _changes(key), length)
                    window, owner, key = window[order], owner[order], key[order]
                    place_in = window - offsets[owner]
                    again = _repeated([ids[owner], rows[owner], place_in], new)
                    gone = pa.nulls(int(again.sum()), pa.int64())
                    twice = owner[again]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[twice]), pa.array(ids[twice]), pa.array(rows[twice]), gone, pa.nulls(len(gone), pa.binary()), pa.array(place_in[again]), pa.array(place_in[again] + length)], CONTEXT_NAMES)
                    w, o = window[new], owner[new]
                    yield batch_of(key[new], ids[o], rows[o], w - offsets[o], cut(data, w, np.full(len(w), length)))

    return send


def _hash_at(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` bytes at each start, equal to the one from prefix sums."""
    up, _ = T.powers(size)
    out = np.zeros(len(start), np.uint64)
    for k in range(size):
        out += T.BYTE_CODE[data[start + k]] * up[k]
    return out


SPANS = "id bigint, row bigint, s bigint, e bigint"
SPAN_NAMES = [x.split()[0] for x in SPANS.split(", ")]


def _window_comparer(length: int):
    """Groups of contexts, in order of g: all but the first of equal windows are removed."""

    def group(cols: list) -> pa.RecordBatch:
        g, ids, row, start, data, offsets = cols
        n = np.diff(offsets) - length + 1
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[:-1][owner] + inner
        p = T.prefix_hash(data)
        _, down = T.powers(len(data))
        raw = (p[at + length] - p[at]) * down[at]
        tokens = [g[owner], T.mix(raw), ids[owner], row[owner], start[owner] + inner, at]
        order = multikey_quicksort(tokens)
        tokens = [t[order] for t in tokens]
        order, new = exact_runs(data, tokens[5], _changes(tokens[0], tokens[1]), length)
        tokens = [t[order] for t in tokens]
        again = _repeated(tokens[2:5], new)
        ids, row, w = (t[again] for t in tokens[2:5])
        order = np.lexsort((w, row, ids))
        ids, row, w = ids[order], row[order], w[order]
        first = np.ones(len(w), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]) | (w[1:] > w[:-1] + 1)
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(w)) - 1 if len(w) else begin
        return pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(row[begin]), pa.array(w[begin]), pa.array(w[last] + length)], SPAN_NAMES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            gone = batch.filter(batch.column("s").is_valid())
            if len(gone):
                yield gone.select(SPAN_NAMES)
            batch = batch.filter(batch.column("s").is_null())
            if not len(batch):
                continue
            g = batch.column("g").to_numpy()
            if held and size > PIECE and held[-1].column("g")[-1].as_py() != g[0]:
                yield group(_joined(held))
                held, size = [], 0
            cut = int(np.searchsorted(g, g[-1]))
            if size + batch.nbytes > PIECE and cut:
                yield group(_joined([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield group(_joined(held))

    return compare


def _joined(held: list[pa.RecordBatch]) -> list:
    t = pa.Table.from_batches(held).combine_chunks()
    data, offsets = T.utf8(t.column("bytes").combine_chunks() if t.column("bytes").num_chunks != 1 else t.column("bytes").chunk(0))
    return [t.column(c).to_numpy() for c in ("g", "id", "row", "start")] + [data[offsets[0] : offsets[-1]], offsets - offsets[0]]


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies the spans (flat start, end longs) of each document."""
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        n_removed, n_spans, digests, spans = [], [], [], []
        for i in range(len(batch)):
            text = data[offsets[i] : offsets[i + 1]]
            merged: list[list[int]] = []
            for s, e in sorted(zip(starts[i] or (), ends[i] or ())):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            digest, at = hashlib.sha256(), 0
            for s, e in merged:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            n_removed.append(sum(e - s for s, e in merged))
            n_spans.append(len(merged))
            digests.append(digest.hexdigest())
            spans.append([x for m in merged for x in m])
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def sample_splitters(keyed: DataFrame, n_buckets: int, n_docs: int, length: int, gram: int, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Splitters (gram, first half of the digest) from the suffixes of about ``sample_docs`` documents, or one for each bucket if that is more."""
    sample_docs = max(sample_docs, n_buckets)
    sample = keyed if n_docs <= sample_docs else keyed.sample(sample_docs / n_docs, seed=5)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in _suffixes(batch, length, gram):
                thin = slice(None, None, 4)
                yield pa.RecordBatch.from_arrays([pa.array(c[thin].view(np.int64)) for c in cols[:2]], ["gram", "c1"])

    found = sample.mapInArrow(tokens, "gram bigint, c1 bigint").toArrow()
    a, b = (found.column(c).to_numpy().view(np.uint64) if len(found) else np.zeros(0, np.uint64) for c in ("gram", "c1"))
    order = np.lexsort((b, a))
    pick = np.unique((np.arange(1, n_buckets) * len(order)) // n_buckets) if len(order) >= n_buckets else np.zeros(0, np.int64)
    return a[order][pick], b[order][pick]


def _joined_by_text(keyed: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Keyed documents with the grouped events (i, r, ...) of their row."""
    return keyed.join(other.hint("shuffle_hash"), (F.col("id") == F.col("i")) & (F.col("row") == F.col("r")), how)


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Keyed documents (doc_id, id, row, text) and the byte spans (id, row, s, e) to remove."""
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID).cast("bigint")).alias("id"), F.xxhash64("doc_id", body).alias("row"), body.alias("text"))
    n_docs, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    n = max(partitions(spark), spark.sparkContext.defaultParallelism, -(-size // bucket_bytes))
    splitters = spark.sparkContext.broadcast(sample_splitters(keyed, n, n_docs, length, gram))
    sent = keyed.select("id", "row", "text").mapInArrow(_sender(splitters, n, length, gram), EVENTS)
    sorted_ = sent.repartitionById(n, F.col("part")).mapInArrow(_sorter(splitters, length, hot), EVENTS)
    # Stored, so that the shuffle before is let go; rebalanced into few files.
    events = stored(sorted_.select("id", "row", "kind", "s", "e").hint("rebalance"), "suffix-events")
    flagged = F.when(F.col("kind") == HOT_CONTEXT, F.bitwise_not("s")).otherwise(F.col("s"))
    ats = events.where(F.col("kind") != REMOVED).groupBy(F.col("id").alias("i"), F.col("row").alias("r")).agg(F.collect_list(flagged).alias("ats"))
    left = _joined_by_text(keyed.select("id", "row", "text"), ats, "inner").select("id", "row", "text", "ats")
    met = left.mapInArrow(_contexts(length, gram), CONTEXTS).repartition(n, "g").sortWithinPartitions("g")
    windows = met.mapInArrow(_window_comparer(length), SPANS)
    return keyed, events.where(F.col("kind") == REMOVED).select(*SPAN_NAMES).union(windows)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (flat start, end of the removed byte runs)."""
    keyed, spans = removed_spans(docs, length, gram, hot)
    gone = spans.groupBy(F.col("id").alias("i"), F.col("row").alias("r")).agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
    joined = _joined_by_text(keyed, gone, "left").select("doc_id", "text", "starts", "ends")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_remover, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("removed").hint("rebalance")


OP1_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS first FROM dup),
numbered AS (SELECT doc_id, p, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM mark),
spans AS MATERIALIZED (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM numbered GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT doc_id, coalesce(e, 0), n FROM d LEFT JOIN (SELECT doc_id, max(e) AS e FROM spans GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
