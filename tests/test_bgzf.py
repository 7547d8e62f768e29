"""BGZF files, written here block by block, read in one task and in many."""

import random
import struct
import zlib

import pytest

from strandloom.sources import bgzf, fasta

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzip(text: bytes, size: int) -> bytes:
    out = b""
    for i in range(0, len(text), size):
        part = text[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        head = bgzf.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + EOF


def rows(spark, path, split):
    df = bgzf.read_bgzf(spark, [str(path)], split)
    return [(r.header, r.seq, r.quality) for r in df.orderBy("block", "at").collect()], df.rdd.getNumPartitions()


@pytest.mark.parametrize(("size", "split"), [(40, 100), (1, 500), (97, 64), (60_000, bgzf.SPLIT)])
def test_fasta(spark, tmp_path, size, split):
    """Records over edges of blocks and of tasks, also of many tasks; headers with '>' inside; empty sequences."""
    rng = random.Random(size)
    want = [(f"r{i} a>b", "".join(rng.choices("ACGT", k=rng.choice([0, 3, 70, 400])))) for i in range(12)]
    text = "".join(f">{h}\r\n" + "".join(f"{s[j : j + 50]}\n" for j in range(0, len(s), 50)) for h, s in want)
    (tmp_path / "x.fa.gz").write_bytes(bgzip(text.encode(), size))
    got, tasks = rows(spark, tmp_path / "x.fa.gz", split)
    assert [r[:2] for r in got] == want
    assert tasks > 3 or size == 60_000


@pytest.mark.parametrize(("size", "split"), [(40, 100), (5, 300), (97, 64), (60_000, bgzf.SPLIT)])
def test_fastq(spark, tmp_path, size, split):
    """Qualities that begin with '@' and '+', reads without bases, and a last line without its end."""
    rng = random.Random(size)
    want = []
    for i in range(25):
        n = rng.choice([0, 1, 5, 90])
        want.append((f"r{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I", k=n))))
    (tmp_path / "x.fq.gz").write_bytes(bgzip("\n".join(f"@{h}\n{s}\n+\n{q}" for h, s, q in want).encode(), size))
    got, tasks = rows(spark, tmp_path / "x.fq.gz", split)
    assert got == want
    assert tasks > 3 or size == 60_000


def test_damage(spark, tmp_path):
    text = b"".join(b">%d\nACGTACGT\n" % i for i in range(200))
    good = bgzip(text, 300)
    (tmp_path / "cut.gz").write_bytes(good[:-60])
    changed = bytearray(good)
    changed[len(good) // 2] ^= 255
    (tmp_path / "changed.gz").write_bytes(changed)
    for name in ("cut.gz", "changed.gz"):
        with pytest.raises(Exception, match="cut or damaged"):
            rows(spark, tmp_path / name, bgzf.SPLIT)
    for name, bad, what in (("t.gz", b"ACGT\n", "neither"), ("q.gz", b"@r\nACGT\n+\nII\n", "no FASTQ record"), ("p.gz", b"@r\nAC\n", "no FASTQ record")):
        (tmp_path / name).write_bytes(bgzip(bad, 4))
        with pytest.raises(Exception, match=what):
            rows(spark, tmp_path / name, bgzf.SPLIT)
    (tmp_path / "e.gz").write_bytes(EOF)
    assert rows(spark, tmp_path / "e.gz", bgzf.SPLIT)[0] == []


def test_among_other_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a x\nACGT\nAC\n")
    (tmp_path / "b.fq.gz").write_bytes(bgzip(b"@r1 y\nACGT\n+\n@II>\n", 7))
    (tmp_path / "c.fa.gz").write_bytes(bgzip(b">c\nTT\n>d\nGG", 3))
    assert sorted((r.header, r.seq) for r in fasta.read_sequences(spark, str(tmp_path)).collect()) == [("a x", "ACGTAC"), ("c", "TT"), ("d", "GG"), ("r1 y", "ACGT")]
    placed = fasta.read_sequences(spark, str(tmp_path), place=True).orderBy(fasta.PLACE).collect()
    assert [r.header for r in placed] == ["a x", "r1 y", "c", "d"]
