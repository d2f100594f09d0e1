import gzip
import random

import pytest

from kmerloom.sources import fasta, formats


def test_later_files_win_whatever_their_size(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("x\tfrom_a\n")
    (tmp_path / "t/b.txt").write_text("x\tfrom_b\n" + "".join(f"y{k}\tz\n" for k in range(50)))
    assert {r.seq_id: r.lineage for r in fasta.read_taxonomy(spark, str(tmp_path / "t")).collect()}["x"] == "from_b"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.fa").write_text(">x\nAAAA\n")
    (tmp_path / "f/b.fa").write_text(">x\nCCCC\n" + "".join(f">y{k}\nACGT\n" for k in range(50)))
    rows = {r.seq_id: r.sequence for r in fasta.last_by_id(fasta.read_fasta(spark, str(tmp_path / "f"))).collect()}
    assert rows["x"] == "CCCC" and len(rows) == 51
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.txt").write_text("p\t1\tclass\np\t1\torder\n")
    (tmp_path / "r/b.txt").write_text("short\np\t1\tgenus\n" + "q\t1\tclass\n" * 40)
    assert {r.path: r.rank for r in fasta.read_rank_lookup(spark, str(tmp_path / "r")).collect()} == {"p": "genus", "q": "class"}


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 1 << 20])
def test_every_range_size_gives_the_same_records(tmp_path, size, monkeypatch):
    """Without Spark: the ranges of one file, read one by one, with buffers of a few bytes."""
    monkeypatch.setattr(formats, "CHUNK", 11)
    r = random.Random(1)
    text = "".join(f">id{k} a>b\n" + "".join("".join(r.choices("ACGT>", k=r.randint(0, 9))).lstrip(">") + "\n" for _ in range(r.randint(0, 4))) for k in range(60))
    (tmp_path / "x.fa").write_text(text)
    reader = formats.FastaReader({"path": str(tmp_path), "rangeBytes": str(size)})
    got = [row for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    want = [(h, s.replace("\n", "")) for h, _, s in (x.partition("\n") for x in ("\n" + text).split("\n>")[1:])]
    assert [(x["header"], x["sequence"]) for x in got] == want
    assert [x["ord"] for x in got] == sorted({x["ord"] for x in got})
    reads = "".join(f"@r{k}\n{'ACGT' * (k % 3)}\n+\n{'@+@I' * (k % 3)}\n" for k in range(50))
    (tmp_path / "x.fq").write_text(reads)
    reader = formats.FastqReader({"path": str(tmp_path / "x.fq"), "rangeBytes": str(size)})
    got = [row for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    assert [(x["read_id"], x["quality"]) for x in got] == [(f"r{k}", "@+@I" * (k % 3)) for k in range(50)]
    reader = formats.LinesReader({"path": str(tmp_path / "x.fq"), "rangeBytes": str(size)})
    assert [row["value"] for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()] == reads.splitlines()


def test_options_and_odd_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fa").write_text(">a\nAC\n")
    (tmp_path / "sub/b.fa").write_text(">b\nGT")
    (tmp_path / "c.txt").write_text(">c\nTT\n")
    (tmp_path / "empty.fa").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden.fa").write_text(">h\nA\n")
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write("".join(f">z{k}\nACGT\nAC\n" for k in range(1000)))
    formats.register(spark)
    read = lambda **o: spark.read.format("fasta").options(**o).load(str(tmp_path))
    assert sorted(r.header for r in read(glob="*.fa").collect()) == ["a", "b"]
    rows = read(rangeBytes="100").orderBy("ord").collect()
    assert len(rows) == 1003 and [r.header for r in rows[:3]] == ["a", "c", "b"] and {r.sequence for r in rows[3:]} == {"ACGTAC"}
    assert {r.file for r in rows} == {"a.fa", "b.fa", "c.txt", "z.fa.gz"}
    assert read(glob="none*").count() == 0 and fasta.read_fasta(spark, str(tmp_path / "missing")).count() == 0
    assert fasta.exists(str(tmp_path)) and not fasta.exists(str(tmp_path / "missing"))
    (tmp_path / "i.tsv").write_text("head\n\n a \tb\tc\td \n\nx\ty\n")
    index = spark.read.format("taxonomy_index").load(str(tmp_path / "i.tsv"))
    assert [tuple(r)[:3] for r in index.orderBy("ord").collect()] == [("a", "b", "c\td"), ("x", "y", None)]
    with pytest.raises(Exception, match="fewer than three"):
        fasta.read_taxonomy_index(spark, str(tmp_path / "i.tsv"), strict=True).collect()
