"""Sequence encoding: canonical k-mer ids of sequences and sliding windows.

An encoded sequence is its list of k-mer ids (positions do not matter to its hypervector). Unknown k-mers are skipped.
The encoders run as Arrow batches over numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import dna, hv
from kmerloom.session import stored

_CODE = np.full(256, -1, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i


def sequence_ids(sequence: bytes, k: int = dna.KMER_SIZE) -> np.ndarray:
    """Canonical k-mer id at each position, -1 where the k-mer has an unknown base."""
    codes = _CODE[np.frombuffer(sequence, np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    number, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        part = codes[i : i + n]
        number, bad = number * 4 + np.maximum(part, 0), bad | (part < 0)
    return np.where(bad, -1, hv.kmer_ids(k)[number].astype(np.int64))


def counts_of(ids: np.ndarray, n_kmers: int = 512) -> np.ndarray:
    return np.bincount(ids[ids >= 0], minlength=n_kmers).astype(np.float64)


def counts_of_lists(lists: pa.Array, n_kmers: int = 512) -> np.ndarray:
    """Count matrix of a column of id lists, without a Python object per id."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    return np.bincount(row * n_kmers + ids, minlength=len(lists) * n_kmers).reshape(len(lists), n_kmers).astype(np.float64)


_BASE_OF = np.full(256, ord("."), np.uint8)
for _i, _b in enumerate(range(ord("A"), ord("Z") + 1)):
    _BASE_OF[[_b, _b + 32]] = ord(dna.BASES[_i % 4])


def dna_of_texts(texts: pa.Array) -> pa.Array:
    """The rows of ``dna.text_to_dna`` for whole texts, by a table over their bytes: a code point's first byte stands for it, those that follow fall away. Null stays."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if not len(texts):
        return texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    offsets, whole = offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    first = (whole & 0xC0) != 0x80
    if not first.all():
        offsets, whole = np.concatenate([[0], np.cumsum(first)])[offsets], whole[first]
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_BASE_OF[whole])).cast(pa.string())
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), made) if texts.null_count else made


def dna_column(text: Column) -> Column:
    """:func:`dna_of_texts` of a column."""

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return dna_of_texts(texts)

    return made(text)


def counts_of_sequences(column: pa.Array, k: int = dna.KMER_SIZE, n_kmers: int = 512) -> np.ndarray:
    """Count matrix of the k-mers of a string column, all rows in one go. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    codes = _CODE.astype(np.int8)[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.int8)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros((len(column), n_kmers))
    bad, codes = codes < 0, np.maximum(codes, 0).astype(np.uint16)
    number, wrong = codes[:n].copy(), bad[:n].copy()
    for i in range(1, k):
        number <<= 2
        number |= codes[i : i + n]
        wrong |= bad[i : i + n]
    # k-mers that reach over the end of a row
    for i in range(1, k):
        at = offsets[1:-1] - offsets[0] - i
        wrong[at[(at >= 0) & (at < n)]] = True
    # what is none is counted in a last column
    ids = hv.kmer_ids(k)[number].astype(np.int64)
    ids[wrong] = n_kmers
    ids += np.repeat(np.arange(len(column)) * (n_kmers + 1), np.diff(offsets))[:n]
    return np.bincount(ids, minlength=len(column) * (n_kmers + 1)).reshape(len(column), -1)[:, :n_kmers].astype(np.float64)


def window_lists(ids: np.ndarray, n_bases: int, rule: str, mode: str, width: int = dna.WINDOW, slide: int = dna.SLIDE, k: int = dna.KMER_SIZE) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the windows of one sequence.

    ``direct``: the width - k + 1 k-mers of each window. ``incremental``: the sliding update whose later windows hold
    their first width - k k-mers and the k-mer at offset width - k of the sequence. ``gpu`` windows hold width - k k-mers.
    A ``cpu`` sequence that is not longer than a window is one window as a whole.
    """
    if mode not in ("direct", "incremental"):
        raise ValueError(f"unknown mode {mode!r}")
    if rule == "cpu" and n_bases <= width:
        return [(0, ids)]
    last = n_bases - width - (1 if rule == "cpu" else 0)
    per = width - k + (0 if rule == "gpu" else 1)
    out = []
    for t in range(0, last + 1, slide) if last >= 0 else ():
        own = ids[t : t + per]
        if rule == "cpu" and mode == "incremental" and t:
            own = np.concatenate([ids[t : t + per - 1], ids[width - k : width - k + 1]])
        out.append((t, own))
    return out


#: Rows, and bytes or ids, that an encoder works on at once (one longer sequence is a part of its own).
PART_ROWS = 256
PART_SIZE = 1 << 20


def small_parts(batch: pa.RecordBatch, col: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bounded size of a string or list column, so that an encoder's memory does not grow with the batch."""
    column = batch.column(col)
    size = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    total = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(size, 0), np.int64))])
    lo = 0
    while lo < len(batch):
        hi = int(min(lo + PART_ROWS, max(lo + 1, np.searchsorted(total, total[lo] + PART_SIZE, "right") - 1)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _bytes(col: pa.Array) -> Iterator[bytes]:
    for x in pc.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary()):
        yield x.as_buffer().to_pybytes()


def _lists(lists: list[np.ndarray]) -> pa.Array:
    known = [x[x >= 0].astype(np.int16) for x in lists]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in known])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(known) if known else np.zeros(0, np.int16)))


def norms(lists: list[np.ndarray]) -> np.ndarray:
    """Squared lengths c G c of the hypervectors of id lists."""
    g = hv.gram()
    c = np.stack([counts_of(x) for x in lists]) if lists else np.zeros((0, len(g)))
    return ((c @ g) * c).sum(1)


_padded: dict[str, np.ndarray] = {}


def window_norms(ids: np.ndarray, starts: np.ndarray, per: int) -> np.ndarray:
    """Squared lengths of the windows of ``per`` k-mers that start at ``starts``: running sums of G along its diagonals.

    An unknown k-mer (-1) is a row of zeros. All sums are integers below 2**53.
    """
    if not len(starts):
        return np.zeros(0)
    if "g" not in _padded:
        g = hv.gram()
        _padded["g"] = np.pad(g, ((0, 1), (0, 1))).astype(np.int32)  # half the bytes: it stays in the processor's cache
    g, n = _padded["g"], len(_padded["g"])
    rows = np.where(ids < 0, n - 1, ids).astype(np.int64)
    flat, base = g.ravel(), rows * n
    out, total = np.zeros(len(starts)), np.zeros(len(ids) + 1, np.int64)
    for lag in range(min(per, len(ids))):
        m = len(ids) - lag
        np.cumsum(np.take(flat, base[:m] + rows[lag:], mode="clip"), out=total[1 : m + 1])
        out += (total[starts + per - lag] - total[starts]) * (2 if lag else 1)
    return out


def encode_sequences(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """All columns plus ids (array<smallint>) and norm2 (bigint) of the whole sequence. Null encodes as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, seq_col):
                ids = [sequence_ids(s) for s in _bytes(part.column(seq_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), pa.array(norms(ids).astype(np.int64))], [*part.schema.names, "ids", "norm2"])

    plain = df.drop("ids", "norm2")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(encode, f"{fields}, ids array<smallint>, norm2 bigint")


def counts_of_blobs(blobs: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Count matrix of a column of :func:`count_vectors`."""
    return np.frombuffer(b"".join(blobs.to_pylist()), np.int32).reshape(len(blobs), -1).astype(kind)


def count_vectors(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """All columns but ids, with counts (binary: a 32-bit number for each k-mer id) and norm2, from ids or else from the sequence. Null counts as empty.

    Two kilobytes a row, however long the sequence is.
    """
    coded = "ids" in df.columns
    rest = [c for c in df.columns if c not in ("ids", "counts", "norm2")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = hv.gram()
        for batch in batches:
            for part in small_parts(batch, "ids" if coded else seq_col):
                c = counts_of_lists(part.column("ids")) if coded else counts_of_sequences(part.column(seq_col))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in rest), pa.array([x.tobytes() for x in c.astype(np.int32)], pa.binary()), pa.array(((c @ g) * c).sum(1).astype(np.int64))], [*rest, "counts", "norm2"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in rest)
    return df.select(*rest, *(["ids"] if coded else [])).mapInArrow(count, f"{fields}counts binary, norm2 bigint")


def encode_through(df: DataFrame, path: str, seq_col: str = "sequence", buckets: int = 64) -> tuple[DataFrame, int]:
    """The rows of :func:`encode_sequences`, and how many sequences were encoded: encodings are kept at ``path`` over runs.

    The store is a bucketed and sorted table of (digest, ids, norm2) by the sequence's SHA-256; it is declared anew by each session, with the same ``buckets``.
    Distinct sequences that it lacks, found by an anti-join, are encoded and added; rows then meet it by digest, without a shuffle of the store. Whatever
    two runs at once have added twice counts once.
    """
    spark = df.sparkSession
    name = "encoded_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, ids ARRAY<SMALLINT>, norm2 BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    keyed = df.drop("ids", "norm2").withColumn("_digest", F.sha2(F.coalesce(F.col(seq_col), F.lit("")).cast("binary"), 256))
    lacking = keyed.select(F.col("_digest").alias("digest"), F.coalesce(F.col(seq_col), F.lit("")).alias("sequence")).join(spark.table(name).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    fresh = stored(encode_sequences(lacking).select("digest", "ids", "norm2"), "encoded")
    n = fresh.count()
    if n:
        fresh.repartition(buckets, "digest").write.insertInto(name)
        spark.catalog.refreshTable(name)
    known = spark.table(name).dropDuplicates(["digest"])
    return keyed.join(known, F.col("_digest") == F.col("digest")).drop("_digest", "digest"), n


def encode_windows(df: DataFrame, seq_col: str = "sequence", rule: str = "cpu", mode: str = "direct") -> DataFrame:
    """All columns but the sequence, with window_start, ids and norm2, one row per window."""
    rest = [c for c in df.columns if c not in (seq_col, "window_start", "ids", "norm2")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows, starts, ids, lengths = [], [], [], []
                for r, s in enumerate(_bytes(part.column(seq_col))):
                    every = sequence_ids(s)
                    own = window_lists(every, len(s), rule, mode)
                    if not own:
                        continue
                    at = np.array([t for t, _ in own])
                    rows.append(np.full(len(own), r)), starts.append(at), ids.extend(x for _, x in own)
                    plain = mode == "direct" and len(every) >= len(own[0][1]) > 0 and (len(own) == 1 or len(own[-1][1]) == len(own[0][1]))
                    lengths.append(window_norms(every, at, len(own[0][1])) if plain else norms([x for _, x in own]))
                row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                flat = [np.concatenate(x) if x else np.zeros(0) for x in (starts, lengths)]
                kept = [part.column(c).take(row) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(flat[0].astype(np.int32)), _lists(ids), pa.array(flat[1].astype(np.int64))], [*rest, "window_start", "ids", "norm2"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in rest)
    return df.select(*rest, seq_col).mapInArrow(encode, f"{fields}window_start int, ids array<smallint>, norm2 bigint")


def kmer_counts(df: DataFrame, *keys: str, seq_col: str = "sequence", k: int = dna.KMER_SIZE) -> DataFrame:
    """(*keys, kmer, n): canonical known k-mers of each sequence and how often they occur.

    Each sequence is counted where it is read (one row per distinct k-mer). Only rows of keys that occur more than once are added up: an aggregation of the
    others would hold a row for each k-mer of each sequence of a task and join nothing.
    """
    names = pa.array(hv.canonical_kmers(k))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, seq_col):
                rows, ids, n = [], [], []
                for r, s in enumerate(_bytes(part.column(seq_col))):
                    c = counts_of(sequence_ids(s, k), len(names))
                    own = np.flatnonzero(c)
                    rows.append(np.full(len(own), r)), ids.append(own), n.append(c[own].astype(np.int64))
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(row) for c in keys], names.take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(n))], [*keys, "kmer", "n"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)
    counted = lambda x: x.select(*keys, seq_col).mapInArrow(count, f"{fields}kmer string, n bigint")
    again = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in keys]), "repeated-keys")
    if again.isEmpty():
        return counted(df)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    added = counted(df.join(again, same, "left_semi")).groupBy(*keys, "kmer").agg(F.sum("n").cast("bigint").alias("n"))
    return counted(df.join(again, same, "left_anti")).union(added)


def kmer_counts_native(df: DataFrame, *keys: str, seq_col: str = "sequence") -> DataFrame:
    """The same with built-in functions only: one row per k-mer occurrence, summed before the shuffle."""
    exploded = df.select(*keys, F.explode(dna.known_kmers(F.col(seq_col))).alias("kmer"))
    return exploded.groupBy(*keys, "kmer").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def window_kmer_counts(df: DataFrame, key: str, seq_col: str = "sequence", width: int = dna.WINDOW, slide: int = dna.SLIDE, k: int = dna.KMER_SIZE) -> DataFrame:
    """(key, window_start, kmer, n): the sliding sum by k-mer: each window takes in ``slide`` new k-mers and lets as many old ones go."""
    names = pa.array(hv.canonical_kmers(k))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, s in enumerate(_bytes(batch.column(key + "_sequence"))):
                ids = sequence_ids(s, k)
                starts = np.arange(0, len(s) - width, slide)
                held = np.zeros(len(names) + 1, np.int64)  # the last place is for unknown k-mers
                np.add.at(held, ids[: width - k + 1], 1)
                own, at, n = [], [], []
                for t in starts.tolist():
                    if t:
                        np.add.at(held, ids[t + width - k + 1 - slide : t + width - k + 1], 1)
                        np.add.at(held, ids[t - slide : t], -1)
                    some = np.flatnonzero(held[:-1])
                    own.append(some), at.append(np.full(len(some), t)), n.append(held[some])
                if not own:
                    continue
                size = sum(map(len, own))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.full(size, r))), pa.array(np.concatenate(at).astype(np.int32)), names.take(pa.array(np.concatenate(own))), pa.array(np.concatenate(n))], [key, "window_start", "kmer", "n"])

    return df.select(key, F.col(seq_col).alias(key + "_sequence")).mapInArrow(count, f"`{key}` {df.schema[key].dataType.simpleString()}, window_start int, kmer string, n bigint")


def sliding_kmer_counts(df: DataFrame, key: str, seq_col: str = "sequence", width: int = dna.WINDOW, slide: int = dna.SLIDE, k: int = dna.KMER_SIZE) -> DataFrame:
    """(key, window_start, n_known): known k-mers of each window, as differences of running sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, n = [], [], []
            for r, s in enumerate(_bytes(batch.column(seq_col))):
                start = np.arange(0, len(s) - width, slide)
                total = np.concatenate([[0], np.cumsum(sequence_ids(s, k) >= 0)])
                rows.append(np.full(len(start), r)), starts.append(start), n.append(total[start + width - k + 1] - total[start])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int64))], [key, "window_start", "n_known"])

    return df.select(key, seq_col).mapInArrow(count, f"`{key}` {df.schema[key].dataType.simpleString()}, window_start int, n_known bigint")


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_SHIFTS = np.arange(2 * dna.PACKED - 2, -1, -2)
_MARKS = np.arange(dna.PACKED - 1, -1, -1)


def packed_words(sequence: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of bases, words and marks of unknown bases, as :func:`dna.pack` makes them."""
    symbols = np.frombuffer(sequence, np.uint8)
    if len(symbols) and symbols.max() > 127:
        symbols = np.minimum(np.frombuffer(sequence.decode().encode("utf-32-le"), np.uint32), 255)
    codes = np.pad(_CODE[symbols], (0, -len(symbols) % dna.PACKED)).reshape(-1, dna.PACKED)
    return len(symbols), (np.maximum(codes, 0) << _SHIFTS).sum(1), ((codes < 0) << _MARKS).sum(1).astype(np.int32)


def unpacked(n: int, words: np.ndarray, unknown: np.ndarray, other: str = "N") -> bytes:
    """The sequence of a packed one; ``other``, an ASCII symbol, stands for unknown bases."""
    plain = _LETTERS[(words[:, None] >> _SHIFTS) & 3]
    return np.where((unknown[:, None] >> _MARKS) & 1, np.uint8(ord(other)), plain).astype(np.uint8).tobytes()[:n]


def packed_codes(n: int, words: np.ndarray, unknown: np.ndarray, k: int = dna.KMER_SIZE) -> np.ndarray:
    """The numbers of the known k-mers (k <= 16) in order, by shifts over two neighbouring words, as :func:`dna.packed_kmers` makes them."""
    if not 1 <= k <= dna.PACKED:
        raise ValueError("a k-mer has 1 to 16 bases")
    after = lambda x: np.append(x[1:], x.dtype.type(0))
    words, unknown = words.astype(np.uint64), unknown.astype(np.uint32)
    off = np.arange(dna.PACKED)
    both = ((words << np.uint64(32)) | after(words))[:, None] << (2 * off).astype(np.uint64) if len(words) else np.zeros((0, dna.PACKED), np.uint64)
    marks = ((unknown << np.uint32(dna.PACKED)) | after(unknown))[:, None] << off.astype(np.uint32) if len(words) else np.zeros((0, dna.PACKED), np.uint32)
    last = max(0, n - k + 1)
    known = (marks >> np.uint32(32 - k)).ravel()[:last] == 0
    return (both >> np.uint64(64 - 2 * k)).ravel()[:last][known].astype(np.int64)


PACKED_FIELDS = "n int, words array<bigint>, unknown array<int>"


def _ragged(lists: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(kind) if lists else np.zeros(0, kind)))


def pack_sequences(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """All columns but the sequence, with n, words and unknown of :func:`dna.pack`, by Arrow batches."""
    rest = [c for c in df.columns if c not in (seq_col, "n", "words", "unknown")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, seq_col):
                n, words, unknown = zip(*map(packed_words, _bytes(part.column(seq_col))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(n, pa.int32()), _ragged(words, np.int64), _ragged(unknown, np.int32)], [*rest, "n", "words", "unknown"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in rest)
    return df.select(*rest, seq_col).mapInArrow(pack, fields + PACKED_FIELDS)


def _each_packed(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    words, unknown = part.column("words"), part.column("unknown")
    for r, n in enumerate(part.column("n").to_pylist()):
        yield n, words[r].values.to_numpy(), unknown[r].values.to_numpy()


def unpack_sequences(packed: DataFrame, other: str = "N") -> DataFrame:
    """All columns and the sequence of rows of :func:`pack_sequences`."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, "words"):
                made = [unpacked(*x, other).decode("ascii") for x in _each_packed(part)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], [*part.schema.names, "sequence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    return packed.mapInArrow(unpack, f"{fields}, sequence string")


def packed_kmer_sums(packed: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n, total, most, n_distinct) over the numbers of the known k-mers of each row of :func:`pack_sequences` that has one."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, "words"):
                found = [(r, c) for r, c in enumerate(packed_codes(*x, k) for x in _each_packed(part)) if len(c)]
                rows = [[len(c), int(c.sum()), int(c.max()), len(np.unique(c))] for _, c in found]
                columns = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array([r for r, _ in found], pa.int64())), *(pa.array(x, pa.int64()) for x in columns)], [key, "n", "total", "most", "n_distinct"])

    return packed.mapInArrow(measure, f"`{key}` {packed.schema[key].dataType.simpleString()}, n bigint, total bigint, most bigint, n_distinct bigint")
