"""WARC archives: writing with revisit records, and a salvage reader.

*Writing.* Each row becomes a WARC/1.1 record in a gzip member of its own. Of rows with equal payloads (SHA-1
and length) of at least ``min_revisit`` bytes the one with the largest id is the response; the others are
revisit records that name it and hold no payload. Each task writes files of its own into a folder that all
executors share and reports them in a manifest; only files that a successful task reported are read, so
lost or repeated tasks leave at most files that nobody reads. An archive is closed at ``max_bytes``.

*Salvage reading.* A reader walks over an archive's members. If a member fails (bad header, bad deflate
data, bad CRC or length) or holds no valid record (no version line, unparsable header, wrong length, wrong payload
digest), the reader searches for the next place from which a member or, in plain archives, a version
line can be read, goes on from there, and reports the bytes in between as a quarantined gap. Archives are
read in blocks. A record, packed or not, that claims to be longer than ``longest`` is not valid, so that damage never makes the reader hold
more than that and a block; the manifest has each archive's longest record, foreign archives are read with ``MAX_RECORD``.
``log_gaps`` writes the gaps of a set beside it and logs how many bytes are quarantined.

Defined results: a null payload is empty; a null id makes a record without an id, never a response for
others; rows that repeat an id and payload are each written, the response being one of them (ties: all
rows with the largest id are responses); empty tables give an empty archive set. Other columns are
never looked at. Payloads of any length are written and read whole.
"""

from __future__ import annotations

import hashlib
import logging
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm._common import is_small, kept, lean_batches, partitions, stored, table, work_dir

MIN_REVISIT = 1000
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16
SALTS = 16
#: Longest record of an archive that says nothing about it.
MAX_RECORD = 1 << 28
MANIFEST = "path string, records bigint, bytes bigint, longest bigint"
RECORDS = "path string, start bigint, stop bigint, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, problem string"


def record_id(page_id: int | None) -> str:
    """A record id that follows from the page id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed; a revisit if ``refers_to`` is given (then ``payload`` is not stored)."""
    body = b"" if refers_to is not None else payload
    lines = [f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(uri: str):
    """File system and path of a URI or plain path."""
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)


def _writer(folder: str, compress: bool, max_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(re.sub(r"^file:/+", "file:///", folder))
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done: list[tuple[str, int, int, int]] = []
        out, path, n, size, longest = None, "", 0, 0, 0

        def close() -> None:
            nonlocal out, n, size, longest
            if out is not None:
                out.close()
                done.append((path, n, size, longest))
            out, n, size, longest = None, 0, 0, 0

        for batch in batches:
            for row in range(len(batch)):
                page_id, url, html, n_bytes, digest, refers = (batch.column(k)[row] for k in range(6))
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                record = encode_record(page_id.as_py(), url.as_py(), payload, n_bytes.as_py(), digest.as_py(), refers.as_py())
                plain = len(record)
                if compress:
                    record = gzip_member(record)
                if out is None or size + len(record) > max_bytes:
                    close()
                    path = f"{folder}/{name}-{len(done):04d}.warc{'.gz' * compress}"
                    out = files.open_output_stream(f"{base}/{os.path.basename(path)}", compression=None)
                out.write(record)
                n, size, longest = n + 1, size + len(record), max(longest, plain, len(record))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "records", "bytes", "longest"])

    return write


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows (page_id, url, html, n_bytes, digest, refers_to); refers_to is null for responses.

    The largest id of each payload comes from plain partial aggregation. Payloads that occur more than once are stored and
    joined back: broadcast if they are few, so that no page is shuffled, else by (digest, salt), so that a payload of many pages is dealt out.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select("page_id", "url", body.alias("html")).withColumn("n_bytes", F.octet_length("html").cast("bigint")).withColumn("digest", F.sha1("html"))
    shared = own.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").select(F.col("digest").alias("d"), F.col("n_bytes").alias("b"), "response")
    shared = stored(shared, "warc-shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to")
    same = (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("b"))
    columns = ["page_id", "url", "html", "n_bytes", "digest", refers]
    if is_small(shared, broadcast_rows):
        return own.join(F.broadcast(shared), same, "left").select(*columns)
    dealt = shared.select("d", "b", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, same & (F.col("salt") == F.col("s")), "left").select(*columns)


def write_archives(pages: DataFrame, folder: str, compress: bool = True, min_revisit: int = MIN_REVISIT, max_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages (page_id, url, html); gives the stored manifest (path, records, bytes, longest)."""
    manifest = mark_revisits(pages, min_revisit).mapInArrow(_writer(f"{folder}/archives", compress, max_bytes), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


@dataclass
class Salvaged:
    """A record read (``problem`` empty) or a quarantined gap of bytes."""

    start: int
    stop: int
    header: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    problem: str = ""


class _Source:
    """A stream with a window of bytes that can be looked at more than once."""

    def __init__(self, stream):
        self.stream, self.buffer, self.start, self.ended = stream, b"", 0, False

    def fill(self, n: int) -> None:
        parts, have = [self.buffer], len(self.buffer)
        while have < n and not self.ended:
            more = self.stream.read(BLOCK)
            self.ended = not more
            parts.append(more)
            have += len(more)
        self.buffer = b"".join(parts)

    def drop(self, n: int) -> None:
        self.buffer, self.start = self.buffer[n:], self.start + n


def _parse(data: bytes, longest: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header, payload and length of the record that ``data`` begins with, or what is wrong ('more' if it is cut off)."""
    if not data.startswith(b"WARC/1."):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "more" if len(data) < longest else "header without end"
    header = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "bad header line"
        header[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", header.get("content-length", "")):
        return "bad content length"
    body = end + 4
    stop = body + int(header["content-length"])
    if stop + 4 > longest:
        return "longer than any record"
    if len(data) < stop + 4:
        return "more"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "record does not end where its length says"
    payload = data[body:stop]
    digest = header.get("warc-payload-digest", "")
    if header.get("warc-type") == "response" and digest.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != digest[5:]:
        return "payload digest differs"
    return header, payload, stop + 4


def _member(source: _Source, longest: int) -> tuple[bytes, int] | str:
    """Unpacked bytes and packed length of the gzip member at the window's start, or what is wrong."""
    unpack, out, used, size = zlib.decompressobj(31), [], 0, 0
    try:
        while not unpack.eof:
            source.fill(used + 1)
            piece = source.buffer[used : used + BLOCK]
            if not piece:
                return "member is cut off"
            out.append(unpack.decompress(piece, longest - size + 1))
            used += len(piece)
            size += len(out[-1])
            if size > longest or used > longest + BLOCK:
                return "longer than any record"
    except zlib.error as e:
        return f"bad member: {e}"
    return b"".join(out), used - len(unpack.unused_data)


def salvage(stream, longest: int = MAX_RECORD) -> Iterator[Salvaged]:
    """Records and gaps of an archive, of gzip members or plain records (both may alternate), none longer than ``longest``."""
    source = _Source(stream)
    gap_start, gap_problem = None, ""
    while True:
        source.fill(BLOCK if gap_start is not None else 16)
        if not source.buffer:
            break
        problem, found, length = "neither a member nor a version line", None, 0
        if source.buffer.startswith(b"\x1f\x8b\x08"):
            member = _member(source, longest)
            if isinstance(member, str):
                problem = member
            else:
                parsed = _parse(member[0], longest)
                if isinstance(parsed, str):
                    problem = "record is cut off" if parsed == "more" else parsed
                elif parsed[2] != len(member[0]):
                    problem = "member holds more than a record"
                else:
                    found, length = parsed, member[1]
        elif source.buffer.startswith(b"WARC/1."):
            need = BLOCK
            while (parsed := _parse(source.buffer, longest)) == "more" and not source.ended:
                source.fill(need := max(2 * need, len(source.buffer) + BLOCK))
            if isinstance(parsed, str):
                problem = "record is cut off" if parsed == "more" else parsed
            else:
                found, length = parsed, parsed[2]
        if found:
            if gap_start is not None:
                yield Salvaged(gap_start, source.start, problem=gap_problem)
                gap_start = None
            yield Salvaged(source.start, source.start + length, found[0], found[1])
            source.drop(length)
            continue
        if gap_start is None:
            gap_start, gap_problem = source.start, problem
        source.drop(1)
        while True:  # to the next place that may begin a member or a record
            hits = [p for p in (source.buffer.find(b"\x1f\x8b\x08"), source.buffer.find(b"WARC/1.")) if p >= 0]
            if hits:
                source.drop(min(hits))
                break
            source.drop(max(0, len(source.buffer) - 6))
            before = len(source.buffer)
            source.fill(before + BLOCK)
            if len(source.buffer) == before:
                source.drop(before)
                break
    if gap_start is not None:
        yield Salvaged(gap_start, source.start, problem=gap_problem)


def _reader(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def number(header: dict[str, str], name: str) -> int | None:
        return int(header[name]) if re.fullmatch(r"-?[0-9]{1,19}", header.get(name, "")) else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, longest in zip(batch.column("path").to_pylist(), batch.column("longest").to_pylist()):
                files, at = _open(re.sub(r"^file:/+", "file:///", path))
                with files.open_input_stream(at, compression=None) as stream:
                    for x in salvage(stream, MAX_RECORD if longest is None else longest):
                        h = x.header
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or hashlib.sha1(x.payload).hexdigest()
                        own = (h.get("warc-target-uri"), h.get("warc-type"), number(h, "x-payload-length"), digest, number(h, "x-refers-to-page-id"), x.payload if with_payload else None) if not x.problem else (None,) * 6
                        rows.append((path, x.start, x.stop, number(h, "x-page-id"), *own, x.problem or None))
                        size += len(x.payload) if with_payload else 200
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
        yield batch_of(rows)

    return read


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records (``problem`` null) and quarantined gaps of the manifest's files, one task for each few files."""
    paths = manifest.groupBy("path").agg(F.max("longest").alias("longest")).repartition(max(partitions(spark), spark.sparkContext.defaultParallelism), "path")
    return paths.mapInArrow(_reader(with_payload), RECORDS)


def log_gaps(found: DataFrame, folder: str) -> int:
    """Number of quarantined gaps of :func:`read_archives`; if there are any, they are written to ``folder``/quarantine and a warning is logged."""
    gaps = found.where("problem is not null").select("path", "start", "stop", "problem")
    n, size = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    if n:
        gaps.write.mode("append").parquet(f"{folder}/quarantine")
        logging.getLogger(__name__).warning("%d gaps with %d bytes are quarantined, see %s/quarantine", n, size, folder)
    return n


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    folder = work_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    found = kept(read_archives(spark, manifest))
    log_gaps(found, folder)
    return found.where("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END::BIGINT AS refers_to
FROM r
"""
