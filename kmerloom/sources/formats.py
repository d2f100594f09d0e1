"""Sequence and table files as Spark data sources: ``fasta``, ``fastq``, ``taxonomy_index`` and ``numbered_lines``.

``spark.read.format("fasta").load(path)`` after :func:`register`. A file is cut into byte ranges, one partition each; the reader of a
range goes on to the first record that begins in it and reads the records that begin there, the last one beyond the range's end.
``ord`` is the number of the file, in order of names, and the offset of the record, so that it orders records over all files however
Spark deals out the ranges. Rows come as Arrow batches of a few MB.

Options: ``path`` (a file or a folder, read recursively without hidden files), ``glob`` (a pattern of base names), ``rangeBytes`` (64 MB), and for
``taxonomy_index`` ``header`` and ``strict``. Paths are opened with ``pyarrow.fs``: local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``. Names that end in ``.gz`` are one range.
A missing path has no rows.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
#: Bits of ``ord`` for the offset in a file; the rest is the file's number.
OFFSET_BITS = 44


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def listed(path: str, glob: str | None = None) -> list[pyarrow.fs.FileInfo]:
    """The visible files at or below a path in order of their names."""
    fs, inner = opened(path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.NotFound:
        return []
    if info.type == pyarrow.fs.FileType.File:
        return [info]
    found = fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    shown = [f for f in found if f.is_file and not any(p[:1] in "._" for p in f.path[len(inner) :].strip("/").split("/"))]
    return sorted((f for f in shown if not glob or fnmatch.fnmatch(f.base_name, glob)), key=lambda f: f.path)


class Stream:
    """Bytes of a file from an offset on, read in chunks; only what is not yet consumed is held."""

    def __init__(self, file, at: int):
        self.file, self.base, self.buffer, self.ended = file, at, bytearray(), False
        if at:
            file.seek(at)

    def more(self) -> bool:
        chunk = b"" if self.ended else self.file.read(CHUNK)
        self.ended = not chunk
        self.buffer += chunk
        return bool(chunk)

    def find(self, mark: bytes, at: int) -> int:
        """The offset of the next mark at or after ``at``, or -1."""
        lo = at - self.base
        while True:
            k = self.buffer.find(mark, lo)
            if k >= 0:
                return self.base + k
            lo = max(lo, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return -1

    def take(self, start: int, end: int | None) -> bytes:
        """The bytes from ``start`` to ``end`` (None: all that is left); what is before ``end`` is let go when it is much."""
        if end is None:
            while self.more():
                pass
            end = self.base + len(self.buffer)
        out = bytes(self.buffer[start - self.base : end - self.base])
        if end - self.base > CHUNK:
            del self.buffer[: end - self.base]
            self.base = end
        return out


def fasta_records(s: Stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record without its mark): records begin where a line begins with '>', and at the beginning of a file."""
    at = 0
    if start:
        k = s.find(b"\n>", start - 1)
        if k < 0:
            return
        at = k + 1
    while at < end:
        k = s.find(b"\n>", at)
        record = s.take(at, None if k < 0 else k)
        yield at, record.removeprefix(b">")
        if k < 0:
            return
        at = k + 1


def lines(s: Stream, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range."""
    at = 0
    if start:
        k = s.find(b"\n", start - 1)
        if k < 0:
            return
        at = k + 1
    while end is None or at < end:
        k = s.find(b"\n", at)
        line = s.take(at, None if k < 0 else k)
        if k < 0 and not line:
            return
        yield at, line
        if k < 0:
            return
        at = k + 1


def fastq_records(s: Stream, start: int, end: int, name: str) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, four lines) of the records that begin in the range.

    In the midst of a file a record begins at a line with '@' whose next but one begins with '+': behind a line of qualities that begins
    with '@' come a header and a sequence, which never begins with '+'.
    """
    every = lines(s, start, None)
    held: list[tuple[int, bytes]] = []
    if start:
        for at, line in every:
            held.append((at, line))
            if len(held) == 3:
                if held[0][1].startswith(b"@") and held[2][1].startswith(b"+"):
                    break
                held.pop(0)
                if held[0][0] >= end:
                    return
        else:
            return
    while True:
        for at, line in every:
            held.append((at, line))
            if len(held) == 4:
                break
        if not held or held[0][0] >= end:
            return
        if len(held) < 4 or not held[0][1].startswith(b"@"):
            raise ValueError(f"broken FASTQ record in {name}")
        yield held[0][0], [line.rstrip() for _, line in held]
        held = []


def _joined(record: bytes) -> tuple[str, str]:
    """Header and sequence of a FASTA record, white space at the ends of lines taken off."""
    head, _, rest = record.partition(b"\n")
    if b" " in rest or b"\r" in rest or b"\t" in rest:
        sequence = b"".join(line.rstrip() for line in rest.split(b"\n"))
    else:
        sequence = rest.replace(b"\n", b"")
    return head.rstrip().decode("utf-8", "replace"), sequence.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    columns: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        self.options = options

    def option(self, name: str, default: str = "") -> str:
        return next((v for k, v in self.options.items() if k.lower() == name.lower()), default)

    def partitions(self) -> list[Range]:
        size = int(self.option("rangeBytes", str(RANGE_BYTES)))
        out = []
        for number, f in enumerate(listed(self.option("path"), self.option("glob") or None)):
            if f.path.endswith(".gz"):
                out.append(Range(f.path, number, 0, 1 << 62))
            else:
                out += [Range(f.path, number, at, min(at + size, f.size)) for at in range(0, f.size, size)]
        return out

    def rows(self, part: Range, s: Stream) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file at all
            return
        fs, _ = opened(self.option("path"))
        file = fs.open_input_stream(part.path, compression="gzip") if part.path.endswith(".gz") else fs.open_input_file(part.path)
        name = part.path.rsplit("/", 1)[-1]
        with file:
            rows: list[tuple] = []
            size = 0

            def batch() -> pa.RecordBatch:
                texts = [pa.array([r[c] for r in rows], pa.string()) for c in range(len(self.columns) - 2)]
                own = [pa.array([name] * len(rows), pa.string()), pa.array([(part.number << OFFSET_BITS) + r[-1] for r in rows], pa.int64())]
                return pa.RecordBatch.from_arrays([*texts, *own], list(self.columns))

            for row in self.rows(part, Stream(file, max(part.start - 1, 0))):
                rows.append(row)
                size += sum(len(x) for x in row[:-1] if x is not None) + 64
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()


class FastaReader(_Reader):
    columns = ("header", "sequence", "file", "ord")

    def rows(self, part: Range, s: Stream) -> Iterator[tuple]:
        for at, record in fasta_records(s, part.start, part.end):
            if record.strip():
                yield *_joined(record), at


class FastqReader(_Reader):
    columns = ("read_id", "sequence", "quality", "file", "ord")

    def rows(self, part: Range, s: Stream) -> Iterator[tuple]:
        for at, four in fastq_records(s, part.start, part.end, part.path):
            head, sequence, _, quality = (x.decode("utf-8", "replace") for x in four)
            yield head[1:], sequence, quality, at


class LinesReader(_Reader):
    columns = ("value", "file", "ord")

    def rows(self, part: Range, s: Stream) -> Iterator[tuple]:
        for at, line in lines(s, part.start, part.end):
            yield line.removesuffix(b"\r").decode("utf-8", "replace"), at


class IndexReader(_Reader):
    columns = ("seq_id", "lowest", "lineage", "file", "ord")

    def rows(self, part: Range, s: Stream) -> Iterator[tuple]:
        skip, strict = (self.option(x, d).lower() == "true" for x, d in (("header", "true"), ("strict", "false")))
        for at, line in lines(s, part.start, part.end):
            text = line.removesuffix(b"\r").decode("utf-8", "replace")
            if (skip and not at) or not text.strip(" "):
                continue
            parts = text.split("\t", 2)
            if strict and len(parts) < 3:
                raise ValueError("taxonomy line with fewer than three columns")
            yield *(parts[k].strip(" ") if k < len(parts) else None for k in range(3)), at


class _Source(DataSource):
    reads: type[_Reader]

    def schema(self) -> str:
        return ", ".join(f"{c} {'bigint' if c == 'ord' else 'string'}" for c in self.reads.columns)

    def reader(self, schema) -> DataSourceReader:
        return self.reads(dict(self.options))


class FastaSource(_Source):
    """(header, sequence, file, ord) of each record that is not blank."""

    reads = FastaReader

    @classmethod
    def name(cls) -> str:
        return "fasta"


class FastqSource(_Source):
    """(read_id, sequence, quality, file, ord); a file cut off within a record raises."""

    reads = FastqReader

    @classmethod
    def name(cls) -> str:
        return "fastq"


class LinesSource(_Source):
    """(value, file, ord) of each line."""

    reads = LinesReader

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"


class IndexSource(_Source):
    """(seq_id, lowest, lineage, file, ord) of a taxonomy index: three parts, the third is the rest of the line."""

    reads = IndexReader

    @classmethod
    def name(cls) -> str:
        return "taxonomy_index"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (FastaSource, FastqSource, LinesSource, IndexSource):
        spark.dataSource.register(source)
