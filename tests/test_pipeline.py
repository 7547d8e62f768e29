import random

import pytest

from strandloom import cli, session
from strandloom.operators.graph import Graph
from strandloom.plans import pipeline
from strandloom.sources import fasta
from strandloom.streaming import embed


def test_files_roundtrip(spark, tmp_path):
    rng = random.Random(4)
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(80)) for i in range(3)}
    seqs["s3"] = seqs["s0"][:30] + "NNNN" + seqs["s1"][10:50] + "N"
    s = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    g = Graph.from_sequences(s, ["seq_id"], 11, False).compacted().materialised()
    fasta.write_fasta(g.unitigs.selectExpr("cast(id as string) as seq_id", "seq"), str(tmp_path / "unitigs"))
    g = pipeline.build(spark, str(tmp_path / "unitigs"), str(tmp_path / "graph"), 11)
    fasta.write_fasta(s, str(tmp_path / "in"))
    cli.main(["encode", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "enc"), "-g", str(tmp_path / "graph")])
    cli.main(["decode", "-i", str(tmp_path / "enc"), "-o", str(tmp_path / "out"), "-g", str(tmp_path / "graph")])
    cli.main(["stats-p", "-i", str(tmp_path / "enc")])
    assert {r.header: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == seqs
    other = Graph(g.unitigs.limit(1), 11, False)
    with pytest.raises(ValueError):
        pipeline.decode(spark, str(tmp_path / "enc"), other)


@pytest.mark.parametrize("one", [False, True])
def test_all(spark, tmp_path, one):
    """Files of genomes to encodings by one command, and back."""
    rng = random.Random(8)
    x, y = ("".join(rng.choices("ACGT", k=150)) for _ in range(2))
    want = {"a|chr1": x, "a|chr/2": y, "b|c1": y[:70] + "NNN" + y[60:], "b|c2": x[:90] + x[20:]}
    for g in "ab":
        (tmp_path / f"{g}.fa").write_text("".join(f">{n[2:]}\n{s}\n" for n, s in want.items() if n[0] == g))
    cli.main(["all", "-k", "13", "-i", str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), "-o", str(tmp_path / "out"), *(["--one-graph"] if one else [])])
    names = sorted(p.name for p in (tmp_path / "out/encodings").iterdir())
    assert names == (["all"] if one else ["chr1", "chr_2"])
    got = {}
    for n in names:
        got |= {r.seq_id: r.seq for r in pipeline.decode(spark, str(tmp_path / f"out/encodings/{n}"), Graph.load(spark, str(tmp_path / f"out/graphs/{n}"))).collect()}
    assert got == {k.replace("/", "_"): s for k, s in want.items()}


def test_long_walks_go_in_blocks(spark, tmp_path):
    seq = "".join(random.Random(9).choices("ACGT", k=900))
    s = spark.createDataFrame([("a", seq + seq[100:700] + seq[200:400]), ("b", seq[:50])], "seq_id string, seq string")
    g = Graph.from_sequences(s, ["seq_id"], 11, False).materialised()
    for name, block in (("one", 1 << 16), ("many", 128)):
        pipeline.encode(s, g, str(tmp_path / name), block=block)
    one, many = (sorted(map(str, spark.read.parquet(str(tmp_path / n / "extensions")).select("seq_id", "ext_idx", "kind", "nid", "base", "nb", "off", "at").collect())) for n in ("one", "many"))
    assert one == many
    assert sorted(r.seq for r in pipeline.decode(spark, str(tmp_path / "many"), g).collect()) == sorted(r.seq for r in s.collect())


def test_stream(spark, tmp_path):
    seq = "ACGTTGCAAGGT"
    s = spark.createDataFrame([("a", 0, seq)], "seq_id string, contig_idx int, seq string")
    s.write.parquet(str(tmp_path / "in"))
    g = Graph.from_sequences(s.select("seq_id", "seq"), ["seq_id"], 4, True).materialised()
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    embed.encode_stream(stream, g, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/trims")).first().status == "OK"
    assert spark.read.parquet(str(tmp_path / "out/extensions")).count() >= 1


def test_ids_follow_the_file(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">0\nAACCG\n>2\nCATGA\n>10\nTTGCA\n")
    g = pipeline.build(spark, str(tmp_path / "u.fa"), str(tmp_path / "g"), 4, True)
    assert [r.seq for r in g.unitigs.orderBy("id").collect()] == ["AACCG", "CATGA", "TTGCA"]
    cli.main(["stats-g", "-g", str(tmp_path / "g")])
    assert [r.line for r in g.printed().collect()] == ["Node 0: AACCG", "Node 1: CATGA", "Node 2: TTGCA"]


def test_scratch(spark):
    import os

    with session.scratch(spark):
        gone = session.materialise(spark.range(3), "gone").inputFiles()[0]
        kept = session.materialise(spark.range(3), "kept", keep=True)
    assert not os.path.exists(gone.removeprefix("file://")) and kept.count() == 3


def test_scratch_of_threads(spark):
    """A block deletes what its own thread wrote, and an inner block leaves what the outer one wrote."""
    import os
    import threading

    paths, go, done = {}, threading.Event(), threading.Event()
    path_of = lambda name: session.materialise(spark.range(2), name).inputFiles()[0].removeprefix("file://")

    def other():
        with session.scratch(spark):
            paths["other"] = path_of("other")
            go.set()
            done.wait(60)
            assert os.path.exists(paths["other"])

    t = threading.Thread(target=other)
    t.start()
    go.wait(60)
    with session.scratch(spark):
        outer = path_of("outer")
        with session.scratch(spark):
            inner = path_of("inner")
        assert os.path.exists(outer) and not os.path.exists(inner)
    assert not os.path.exists(outer) and os.path.exists(paths["other"])
    done.set()
    t.join()
    assert not os.path.exists(paths["other"])
