import gzip
import hashlib
import io

from kmerloom.llm import warc

PAGES = [(1, "http://a", "x" * 1500), (2, "http://b\r\nX: y", "x" * 1500), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", "y" * 1200), (9, "z", "WARC/1.1\r\nfake" + "é" * 600), (7, "q", "x" * 1500), (10, "w", "y" * 1200), (10, "w", "y" * 1200)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id bigint, url string, html string, digest string, salt string")
    for compress in (True, False):
        folder = f"{tmp_path}/{compress}"
        manifest = warc.write_archives(pages, folder, compress=compress, max_bytes=2000)
        assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
        got = warc.read_archives(spark, manifest, with_payload=True).collect()
        assert all(r.problem is None for r in got)
        want = []
        for i, _, html in PAGES:
            b = (html or "").encode()
            same = [p for p, _, h in PAGES if (h or "").encode() == b and p is not None]
            refers = max(same) if len(b) >= 1000 and same and max(same) != i else None
            want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers))
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
        for r in got:
            if r.record_type == "response":
                assert hashlib.sha1(r.payload or b"").hexdigest() == r.payload_digest


def records(n):
    return [warc.encode_record(k, f"u{k}", f"page {k} ".encode() * (50 + k), 8 * (50 + k), hashlib.sha1(f"page {k} ".encode() * (50 + k)).hexdigest(), None) for k in range(n)]


def read(data):
    return list(warc.salvage(io.BytesIO(data)))


def ids(found):
    return [int(x.header["x-page-id"]) for x in found if not x.problem]


def test_salvage_plain_and_packed():
    plain = records(6)
    packed = [warc.gzip_member(r) for r in plain]
    assert ids(read(b"".join(plain))) == list(range(6)) and ids(read(b"".join(packed))) == list(range(6))
    assert gzip.decompress(b"".join(packed)) == b"".join(plain)
    for parts in (plain, packed):
        broken = list(parts)
        broken[2] = broken[2][:-60] + b"\xff\x00" + broken[2][-58:]  # damage in place
        broken[4] = broken[4][: len(broken[4]) // 2]  # cut off
        found = read(b"junk" + b"".join(broken) + b"tail")
        assert ids(found) == [0, 1, 3, 5]
        gaps = [(x.start, x.stop) for x in found if x.problem]
        assert sum(b - a for a, b in gaps) == 4 + len(broken[2]) + len(broken[4]) + 4
        spans = sorted((x.start, x.stop) for x in found)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(b"junk" + b"".join(broken) + b"tail")


def test_every_cut_and_flip_keeps_the_rest():
    packed = [warc.gzip_member(r) for r in records(4)]
    data = b"".join(packed)
    edges = [0]
    for p in packed:
        edges.append(edges[-1] + len(p))
    for at in range(0, len(data), 37):
        hurt = next(k for k in range(4) if edges[k] <= at < edges[k + 1])
        flipped = data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :]
        assert set(ids(read(flipped))) >= {0, 1, 2, 3} - {hurt}
        assert ids(read(data[:at])) == list(range(hurt))


def test_mixed_plain_and_packed_and_empty():
    plain = records(3)
    assert ids(read(plain[0] + warc.gzip_member(plain[1]) + plain[2])) == [0, 1, 2]
    assert read(b"") == []


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages, f"{tmp_path}/e")).count() == 0


def test_wrong_lengths_hold_no_more_than_the_longest_record():
    """A wrong digit in a length, or a member that never ends, makes the reader hold at most the longest record and a few blocks."""
    plain = records(400)
    longest = max(map(len, plain))
    data = b"".join(plain)
    at = data.index(b"Content-Length: ") + len(b"Content-Length: ")
    wrong = data[:at] + b"9999999" + data[at:]

    class Watched(io.BytesIO):
        most = taken = 0

    def held(archive):
        stream, most, found = Watched(archive), 0, []
        for x in warc.salvage(stream, longest):
            found.append(x)
            most = max(most, stream.tell() - x.stop)
        return found, most

    found, most = held(wrong)
    assert ids(found) == list(range(1, 400)) and most <= longest + 3 * warc.BLOCK
    bomb = warc.gzip_member(plain[0][:200] + b"0" * 50_000_000)
    found, most = held(bomb + b"".join(map(warc.gzip_member, plain)))
    assert ids(found) == list(range(400)) and most <= longest + 3 * warc.BLOCK


def test_damaged_archives_are_logged_and_the_rest_is_read(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * (100 + k)) for k in range(60)], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, f"{tmp_path}/set", max_bytes=1 << 14)
    paths = sorted(r.path for r in manifest.collect())
    hurt = paths[0]
    with open(hurt, "r+b") as f:
        f.seek(150)
        f.write(b"\x00" * 20)
    found = warc.read_archives(spark, manifest)
    assert warc.log_gaps(found, str(tmp_path)) >= 1
    log = spark.read.parquet(f"{tmp_path}/quarantine").collect()
    assert {r.path for r in log} == {hurt} and all(r.stop > r.start for r in log)
    left = {r.page_id for r in found.where("problem is null").collect()}
    assert 58 <= len(left) < 60
    assert warc.log_gaps(warc.read_archives(spark, manifest.where(manifest.path != hurt)), str(tmp_path)) == 0


def test_many_shared_payloads_are_joined_by_salt(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id bigint, url string, html string, digest string, salt string")
    few, many = (sorted(((r.page_id, r.digest, r.refers_to) for r in warc.mark_revisits(pages, broadcast_rows=n).collect()), key=repr) for n in (1000, 0))
    assert few == many


def test_a_payload_over_a_mebibyte(spark, tmp_path):
    html = "<p>é" * 400_000
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id bigint, url string, html string"), f"{tmp_path}/long")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, manifest).collect()}
    assert got == {2: (len(html.encode()), "response", None), 1: (len(html.encode()), "revisit", 2)}


def test_a_header_of_two_mebibytes_in_a_plain_archive():
    """A page with a very long URL is read back from an archive that is not packed, and the record behind it as well."""
    url = "http://a.example/" + "x" * (2 << 20)
    payloads = [b"first page", b"second page"]
    data = b"".join(warc.encode_record(k, u, p, len(p), hashlib.sha1(p).hexdigest(), None) for k, (u, p) in enumerate(zip((url, "http://b"), payloads)))
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [x.payload for x in found] == payloads and not any(x.problem for x in found) and found[0].header["warc-target-uri"] == url
