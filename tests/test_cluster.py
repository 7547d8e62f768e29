import random

from strandloom import cli
from strandloom.operators import cluster

RECORDS = "genome string, record string, seq string"


def test_communities(spark):
    rows = [("g0", "a", "ACGTTGCAAC"), ("g0", "b", "GGATCCTTAG"), ("g1", "x", "ACGTTGCATT"), ("g1", "y", "CTAAGGATCC"), ("g2", "z", "TTTTTTTTTT")]
    got = {r.record: r.cluster for r in cluster.communities(spark.createDataFrame(rows, RECORDS), "g0", 4).collect()}
    assert got == {"a": "a", "b": "b", "x": "a", "y": "b", "z": "a"}


def test_communities_of_equal_names(spark):
    rows = [("g0", "chr1", "ACGTTGCAAC"), ("g0", "chr2", "GGATCCTTAG"), ("g1", "chr1", "CTAAGGATCC"), ("g2", "chr1", "ACGTTGCATT"), ("g2", "chr2", "GGATCCTTAG")]
    got = {(r.genome, r.record): r.cluster for r in cluster.communities(spark.createDataFrame(rows, RECORDS), "g0", 4).collect()}
    assert got == {("g0", "chr1"): "chr1", ("g0", "chr2"): "chr2", ("g1", "chr1"): "chr2", ("g2", "chr1"): "chr1", ("g2", "chr2"): "chr2"}


def test_sketch(spark):
    s = cluster.sketch(spark.createDataFrame([("a", "ACGTTGCAAC")], "name string, seq string"), "name", 4, 3).first()
    assert len(s.hashes) == 3 and s.hashes == sorted(s.hashes)


def test_sketched_containment(spark):
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    shared, own = dna(4000), dna(4000)
    q = spark.createDataFrame([("whole", shared), ("half", shared[:2000] + dna(2000)), ("none", dna(3000))], "query string, seq string")
    r = spark.createDataFrame([("r", shared + own), ("s", dna(5000))], "reference string, seq string")
    exact = {(x.query, x.reference): x.score for x in cluster.containment(q, r, 15).collect()}
    got = {(x.query, x.reference): x.score for x in cluster.sketched_containment(q, r, 15, 800).collect()}
    assert set(got) == set(exact) == {("whole", "r"), ("half", "r")}
    assert got["whole", "r"] == 1 and abs(got["half", "r"] - exact["half", "r"]) < 0.1
    all_hashes = {(x.query, x.reference): x.score for x in cluster.sketched_containment(q, r, 15, 100_000).collect()}
    assert all_hashes == exact
    assert cluster.containment(q, r, 15, zeros=True).count() == 6


def test_cluster_command(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 x\nACGTTGCAAC\n>chr2\nGGATCCTTAG\n")
    (tmp_path / "b.fa").write_text(">chr1\nCTAAGGATCC\n")
    cli.main(["cluster", "-k", "4", "-i", str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), "-o", str(tmp_path / "out")])
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/clusters")).collect())
    assert got == [("a", "chr1", "chr1"), ("a", "chr2", "chr2"), ("b", "chr1", "chr2")]
    assert sorted(r.value.strip() for r in spark.read.text(str(tmp_path / "out/sequences/cluster=chr2"), lineSep="\n>").collect()) == [">a|chr2\nGGATCCTTAG", ">b|chr1\nCTAAGGATCC"]
