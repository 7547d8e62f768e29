import gzip

import pytest

from strandloom.operators import cluster
from strandloom.sources import fasta


def test_fasta(spark, tmp_path):
    text = ">a x>y\nACGT\nAC\r\n>b\n\n>c z\nNNA\n"
    (tmp_path / "one.fa").write_text(text)
    with gzip.open(tmp_path / "two.fa.gz", "wt") as f:
        f.write(">d\nTT\n")
    got = sorted((r.header, r.seq) for r in fasta.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("a x>y", "ACGTAC"), ("b", ""), ("c z", "NNA"), ("d", "TT")]
    rows = fasta.sequences(fasta.read_fasta(spark, str(tmp_path)))
    fasta.write_fasta(rows, str(tmp_path / "out"))
    assert sorted((r.header, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect())[0] == ("a", "ACGTAC")
    fasta.split_records(fasta.read_fasta(spark, str(tmp_path / "one.fa")), str(tmp_path / "split"))
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"name=a", "name=b", "name=c"}


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+\n@@\n")
    got = sorted(tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "r.fq")).collect())
    assert got == [("r1 x", "ACGT", "@III"), ("r2", "GG", "@@")]
    placed = fasta.read_sequences(spark, str(tmp_path / "r.fq"), place=True).orderBy(fasta.PLACE)
    assert placed.columns == [*fasta.PLACE, "header", "seq"] and [r.header for r in placed.collect()] == ["r1 x", "r2"]


def test_tsv_and_logs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#1\n#2\n#3\n#4\n1\t2\n3\t4\n")
    assert sorted(tuple(r) for r in fasta.read_tsv(spark, str(tmp_path / "t.tsv"), "a int, b int").collect()) == [(1, 2), (3, 4)]
    (tmp_path / "log").write_text("R:10-3\nSP:12\nNN\n>x\n")
    assert sorted(tuple(r) for r in fasta.parse_extensions(spark.read.text(str(tmp_path / "log"))).collect()) == [("NN", 1), ("R", 10), ("SP", 12)]
    (tmp_path / "ls").write_text("-rw-r--r-- 1 u g 123 Jan 1 10:00 yeast8.k23.bin\ntotal 5\n")
    assert [tuple(r) for r in fasta.parse_sizes(spark.read.text(str(tmp_path / "ls"))).collect()] == [(8, 23, "bin", 123)]
    (tmp_path / "stats").write_text("yeast8.k23.bin nodes: 1,204 edges: 2_310 average length: 31.5\nno numbers here\nx4_k31 Edges 7, Nodes 5\n")
    got = sorted(tuple(r) for r in fasta.parse_stats(spark.read.text(str(tmp_path / "stats"))).collect())
    assert got == [(4, 31, 5, 7, None), (8, 23, 1204, 2310, 31.5)]


def test_formats_are_told_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(">a x\nACGT\nAC\n")
    (tmp_path / "in/e").write_text("")
    with gzip.open(tmp_path / "in/b.gz", "wt") as f:
        f.write("@r1 y\nACGT\n+r1\n@II>\n@r2\nGG\n+\n@@\n")
    got = sorted(tuple(r) for r in fasta.read_sequences(spark, str(tmp_path / "in")).collect())
    assert got == [("a x", "ACGTAC"), ("r1 y", "ACGT"), ("r2", "GG")]
    (tmp_path / "x.txt").write_text("ACGT\n")
    with pytest.raises(ValueError, match="neither"):
        fasta.read_sequences(spark, str(tmp_path / "x.txt"))
    for text in ("@r\nACGT\n+\nII\n", "@r\nACGT\nACGT\nIIII\n", "@r\nAC\n+\nII\nr2\nAC\n+\nII\n", "@r\nAC\n"):
        (tmp_path / "bad.fq").write_text(text)
        with pytest.raises(Exception, match="no FASTQ record"):
            fasta.read_sequences(spark, str(tmp_path / "bad.fq")).collect()


def test_wide_tables(spark, tmp_path):
    """Wide to long and back, with genomes that are known only from the header."""
    (tmp_path / "w.tsv").write_text("#1\n#2\n#3\n#4\ngram\tyeast A\tmouse\n1-2\t3\t0\n2-2\t\t5\n")
    assert [tuple(r) for r in fasta.read_tsv(spark, str(tmp_path / "w.tsv"), "g string, a int, b int", header=True).orderBy("g").collect()] == [("1-2", 3, 0), ("2-2", None, 5)]
    long = fasta.read_wide(spark, str(tmp_path / "w.tsv"))
    assert sorted(tuple(r) for r in long.collect()) == [("1-2", "mouse", 0), ("1-2", "yeast A", 3), ("2-2", "mouse", 5)]
    assert sorted((r.genomes, r.grams) for r in cluster.rarity(long).collect()) == [(1, 2)]
    fasta.write_wide(long.repartition(2), str(tmp_path / "back"), ["a", "b"])
    back = fasta.read_wide(spark, str(tmp_path / "back"), 2)
    assert sorted(tuple(r) for r in back.collect()) == [("1-2", "mouse", 0), ("1-2", "yeast A", 3), ("2-2", "mouse", 5), ("2-2", "yeast A", 0)]
