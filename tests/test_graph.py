"""Golden fixtures of small graphs, walks, gaps and encodings, and round trips over seeded random sequences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import codec, encode, paths, scaffold, walk
from strandloom.operators.graph import Graph, positional_kmers
from strandloom.operators.ids import row_numbers


def unitigs(spark, seqs, k, stranded):
    return Graph(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), k, stranded).materialised()


def contigs(spark, *seqs):
    return spark.createDataFrame([(str(i), 0, s) for i, s in enumerate(seqs)], "seq_id string, contig_idx int, seq string")


def node(n):  # 7 -> "-3", 6 -> "+3"
    return f"{'-' if n % 2 else '+'}{n // 2}"


FIXTURE = "GGGCCCCGGGAAAAAC"
STRANDED = ["GGAA", "GGG", "CCC", "CCGG", "AAA", "AAC", "GGCC"]
CANONICAL = ["GGAA", "CCC", "AAA", "CCG", "AAC", "GCC"]


def test_kmers(spark):
    row = spark.createDataFrame([("CTG",)], "s string").select(S.pack(F.col("s")), S.revcomp(F.col("s")), S.extend_right(F.col("s"), F.lit("A")), S.extend_left(F.col("s"), F.lit("A")), S.unpack(S.pack(F.col("s")), 3)).first()
    assert tuple(row) == (0b011011, "CAG", "TGA", "ACT", "CTG")
    assert spark.createDataFrame([("AC",)], "s string").select(S.kmers(F.col("s"), 3)).first()[0] == []
    assert spark.createDataFrame([("acgu nR-",)], "s string").select(S.normalise(F.col("s"))).first()[0] == "ACGTNNN"


@pytest.mark.parametrize(
    ("nodes", "stranded", "steps", "default"),
    [
        (STRANDED, True, "+1 +6 +2 +2 +3 +1 +0 +4 +4 +4 +5", "TN(Node(+1)) NN(1) NN(1) NN(1) NN(3) NN(3) NN(0) NN(0) NN(0) NN(0) NN(1)"),
        (CANONICAL, False, "-1 -5 +5 +1 +1 +3 -3 -1 +0 +2 +2 +2 +4", "TN(Node(-1)) NN(1) NN(1) NN(1) NN(1) NN(3) NN(3) NN(3) NN(0) NN(0) NN(0) NN(0) NN(1)"),
    ],
)
def test_compacted_fixture(spark, nodes, stranded, steps, default):
    g = unitigs(spark, nodes, 3, stranded)
    assert g.duplicate_ends().isEmpty()
    c = contigs(spark, FIXTURE)
    w = walk.walk(c, g)
    assert " ".join(node(r.nid) for r in w.orderBy("step").collect()) == steps
    o = walk.offsets(c, g).first()
    assert (o.status, o.start_offset, o.end_offset) == ("OK", 0, 0)
    assert walk.spell(w, g).first().spelled == FIXTURE
    ext = encode.greedy(w, g)
    assert " ".join(r.line for r in encode.log_lines(ext).orderBy("ext_idx").collect()) == default
    ext = encode.greedy(w, g, encode.Params(1, 50, 10))
    assert all(r.kind == "TN" for r in ext.collect()) and ext.count() == 8
    assert [r.nid for r in encode.decode(ext, g).orderBy("step").collect()] == [r.nid for r in w.orderBy("step").collect()]


def test_neighbours(spark):
    g = unitigs(spark, STRANDED, 3, True)
    got = {node(r.nid): [node(int(x)) for x in r.neighbours.split(",") if x] for r in g.neighbours("R").collect()}
    assert got == {"+0": ["+4", "+5"], "+1": ["+0", "+6", "+1"], "+2": ["+2", "+3"], "+3": ["+0", "+6", "+1"], "+4": ["+4", "+5"], "+5": [], "+6": ["+2", "+3"]}


def test_offsets_and_errors(spark):
    g = unitigs(spark, ["AACCGT"], 3, True)
    c = contigs(spark, "AACC", "CCGT", "ACCG", "AA", "AACCA", "AACCGTA")
    got = {r.seq: (r.status, r.start_offset, r.end_offset) for r in walk.offsets(c, g).join(c, ["seq_id", "contig_idx"]).collect()}
    assert got["AACC"] == ("OK", 0, 2) and got["CCGT"] == ("OK", 2, 0)
    assert got["ACCG"][0] == "INSIDE_NODE" and got["AA"][0] == "TOO_SHORT" and got["AACCA"][0] == "UNITIG_NOT_MATCHING" and got["AACCGTA"][0] == "KMER_NOT_FOUND"


@pytest.mark.parametrize(
    ("seq", "compat", "decoded"),
    [("ACGNNNTTT", [0, 2, 0], "ACGNNNTTT"), ("NNACGNN", [2, 2], "NNACGNN"), ("ACGTNACGT", [0, 0, 0], "ACGTNACGT"), ("NNN", [4], "NNN"), ("", [1], ""), ("ACGNACNTTT", [0, 2, 0], "ACGNNNNTTT")],
)
def test_gaps(spark, seq, compat, decoded):
    s = spark.createDataFrame([("a", seq)], "seq_id string, seq string")
    assert [r.gap_len for r in scaffold.gaps_compat(s, 3).orderBy("gap_idx").collect()] == compat
    assert scaffold.assemble(scaffold.contigs(s, 3), scaffold.gaps_exact(s, 3)).first().seq == decoded


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_gaps_over_chunks(spark, chunk):
    """Chunks of any size give what splitting on N gives: stretches over many chunks, edges at either end, no bases, a null id and a null sequence."""
    rng = random.Random(chunk)
    rows = [(str(i), "".join(rng.choices("ACGTN", [1, 1, 1, 1, rng.choice([1, 4, 20])], k=rng.randrange(1, 60)))) for i in range(40)]
    rows += [("n", "N" * 25), ("b", "ACGTA" * 6), ("e", ""), (None, "NNACGNNACNACGTNN"), ("null", None)]
    s = spark.createDataFrame(rows, "seq_id string, seq string")
    want, exact, compat = set(), set(), set()
    for name, seq in rows:
        at, idx, end, unit = 0, 0, 0, 0
        for piece in ("" if seq is None else seq).split("N"):
            if len(piece) >= 3:
                want.add((name, idx, at, piece))
                exact.add((name, idx, at - end))
                compat.add((name, idx, unit))
                idx, end, unit = idx + 1, at + len(piece), 0
            else:
                unit += len(piece) or 1
            at += len(piece) + 1
        exact.add((name, idx, len(seq or "") - end))
        compat.add((name, idx, unit))
    of = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert of(scaffold.contigs(s, 3, chunk)) == sorted(map(str, want))
    assert of(scaffold.gaps_exact(s, 3, chunk)) == sorted(map(str, exact))
    assert of(scaffold.gaps_compat(s, 3, chunk)) == sorted(map(str, compat))


def test_gap_of_millions(spark):
    """30 million Ns are 30 rows on their way, in several tasks."""
    s = spark.range(1).select(F.lit("x").alias("seq_id"), F.expr("concat('ACGT', repeat('N', 30000000), 'GGA', repeat('C', 1500000))").alias("seq"))
    assert [(r.gap_idx, r.gap_len) for r in scaffold.gaps_exact(s, 4).orderBy("gap_idx").collect()] == [(0, 0), (1, 30_000_000), (2, 0)]
    assert [(r.start, r.n) for r in scaffold.contigs(s, 4).select("start", F.length("seq").alias("n")).orderBy("start").collect()] == [(0, 4), (30_000_004, 1_500_003)]


def test_repetitions():
    assert encode.repetitions_of(np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 4, 4, 4, 4, 4]), 3, 255) == [(3, 6, 2), (10, 4, 0)]
    assert encode.repetitions_of(np.array([ord(c) for c in "abcabcabcabx"]), 3, 255) == [(3, 8, 2)]
    assert encode.repetitions_of(np.array([1]), 1, 255) == []
    with pytest.raises(ValueError):
        encode.Params(min_rep=0)


def test_closed_cycle(spark):
    seq = "AACCGTTGAGTCAACCG"
    s = spark.createDataFrame([("0", seq)], "seq_id string, seq string")
    g = Graph.from_sequences(s, ["seq_id"], 5, True).materialised()
    w = walk.walk(contigs(spark, seq), g)
    ext = encode.greedy(w, g)
    assert [(r.kind, r.nid) for r in ext.orderBy("ext_idx").collect()] == [("TN", 0), ("TN", 0)]
    assert encode.decode(ext, g).count() == 13


@pytest.mark.parametrize(("k", "n", "stranded", "params"), [(5, 1500, False, encode.Params(1, 50, 500)), (7, 400, False, encode.Params(3, 20, 4)), (6, 600, True, encode.Params(2, 30, 3))])
def test_random_roundtrip(spark, k, n, stranded, params):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGT") for _ in range(n))
    g = Graph.from_sequences(spark.createDataFrame([("0", seq)], "seq_id string, seq string"), ["seq_id"], k, stranded).materialised()
    c = contigs(spark, seq)
    w = walk.walk(c, g)
    assert walk.spell(w, g).first().spelled == seq
    ext = encode.greedy(w, g, params)
    assert walk.spell(encode.decode(ext, g), g).first().spelled == seq
    u = g.compacted().materialised()
    assert u.duplicate_ends().isEmpty()
    w2 = walk.walk(c, u)
    assert walk.extract(w2, walk.offsets(c, u), u).first().seq == seq


def test_prefix_is_the_same_both_ways(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(120))
    g = Graph.from_sequences(spark.createDataFrame([("0", seq)], "seq_id string, seq string"), ["seq_id"], 3, True).materialised()
    w = walk.walk(contigs(spark, seq), g)
    a = paths.Adjacency.of(g.edges())
    path = [r.nid for r in w.orderBy("step").collect()]
    got = {r.step: r.length for r in paths.unique_prefix(w, g.edges(), 6).collect()}
    assert got == {i: a.prefix(path, i, 6) for i in range(len(path) - 1)}


def test_save_and_load(spark, tmp_path):
    g = unitigs(spark, STRANDED, 3, True)
    g.save(str(tmp_path / "g"))
    h = Graph.load(spark, str(tmp_path / "g"))
    assert h.k == 3 and h.stranded and h.fingerprint() == g.fingerprint() and h.stats().first().nodes == 7


def test_inside_a_node(spark):
    g = unitigs(spark, ["AACCGT", "GGATTACAGG"], 3, True)
    c = contigs(spark, "ACCG", "GATTACAG", "GATTTCAG", "TTTTT")
    walks, trims = walk.embed(c, g)
    got = {r.seq_id: (r.status, r.start_offset, r.end_offset, r.n_nodes) for r in trims.collect()}
    assert got == {"0": ("OK", 1, 1, 1), "1": ("OK", 1, 1, 1), "2": ("INSIDE_NODE", None, None, None), "3": ("INSIDE_NODE", None, None, None)}
    assert {r.seq_id: r.seq for r in walk.extract(walks, trims, g).collect()} == {"0": "ACCG", "1": "GATTACAG"}
    found = {(r.kmer, r.nid, r.offset) for r in g.search_anywhere(spark.createDataFrame([("CCG",), ("TTA",), ("AAA",)], "kmer string")).collect()}
    assert found == {("CCG", 0, 2), ("TTA", 2, 3), ("AAA", None, None)}
    assert {(r.kmer, r.nid) for r in g.search(spark.createDataFrame([("AAC",), ("CCG",)], "kmer string"), "L").collect()} == {("AAC", 0), ("CCG", None)}


@pytest.mark.parametrize(("k", "n", "stranded", "params"), [(3, 90, True, encode.Params(2, 6, 3)), (5, 120, False, encode.Params(3, 5, 4, max_contig_nodes=37))])
def test_joins_beyond_the_bound(spark, k, n, stranded, params):
    rng = random.Random(n + k)
    seq = "".join(rng.choice("ACGT") for _ in range(n))
    seq += seq[40:70] * 2 + "ACACACACACACACAC" + seq[:30]
    g = Graph.from_sequences(spark.createDataFrame([("0", seq)], "seq_id string, seq string"), ["seq_id"], k, stranded).compacted().materialised()
    c = contigs(spark, seq, seq[17:80], seq[60:])
    w = walk.embed(c, g, broadcast_nodes=0)[0]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(w) == rows(walk.embed(c, g)[0])
    small = encode.greedy(w, g, params)
    assert rows(encode.greedy(w, g, params, 0)) == rows(small)
    assert rows(encode.decode(small, g, 0)) == rows(encode.decode(small, g)) == rows(w.select("seq_id", "contig_idx", "step", "nid"))


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (3, 4), (5, 5)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 4), (0, 0), (5, 5), (4, 0), (3, 4)], "src long, dst long")
    got = {}
    for r in paths.shortest(edges, pairs).orderBy("i").collect():
        got.setdefault((r.src, r.dst), []).append(r.nid)
    assert got == {(0, 4): [1, 3, 4], (0, 0): [1, 3, 0], (5, 5): [5], (3, 4): [4]}


def test_long_sequence(spark):
    """A sequence of many chunks gives the k-mers of its whole, and a walk of it numbers them in order over blocks."""
    rng = random.Random(6)
    seq = "".join(rng.choices("ACGT", k=40_000)) + "N" + "".join(rng.choices("ACGT", k=20_000))
    rows = positional_kmers(spark.createDataFrame([("a", seq), ("b", "ACG"), ("c", "")], "seq_id string, seq string"), 13, True).where("seq_id = 'a'").orderBy("pos").collect()
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    n = len(seq)
    assert [(r.pos, r.kmer, r.canon) for r in rows] == [(i, seq[i : i + 13], min(seq[i : i + 13], back[n - i - 13 : n - i])) for i in range(n - 12)]
    numbers = row_numbers(spark.range(0, 3000, 3).selectExpr("'a' as key", "id"), ["key"], "id", "step", 64)
    assert sorted((r.id, r.step) for r in numbers.collect()) == [(3 * i, i) for i in range(1000)]


def test_packing_bases(spark):
    seqs = ["", "A", "ACTG", "GGTCA", "ACGT" * 9 + "C"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.pack_bases(F.col("s")).alias("b")).select("s", "b", S.unpack_bases(F.col("b"), F.length("s")).alias("back"))
    for r in df.collect():
        assert r.back == r.s and len(r.b) == -(-len(r.s) // 4)
    with pytest.raises(Exception, match="31"):
        spark.createDataFrame([("A" * 32,)], "s string").select(S.pack(F.col("s"))).collect()


def test_blobs(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(300)) + "ACAC" * 200
    seq += seq[40:200]
    g = Graph.from_sequences(spark.createDataFrame([("0", seq)], "seq_id string, seq string"), ["seq_id"], 5, False).compacted().materialised()
    w, _ = walk.embed(contigs(spark, seq, seq[90:400]), g)
    own = ["kind", "base", "nb", "off"]
    for params in (encode.Params(2, 9, 3), encode.Params(2, 9, 3, max_contig_nodes=40)):
        ext = encode.greedy(w, g, params)
        blobs = codec.to_bytes(ext).collect()
        sizes = {(r.seq_id, r.contig_idx, r.piece): r.bytes for r in encode.encoded_bytes(ext.selectExpr("*", f"floor(ext_idx / {encode.PIECE}) as piece"), ["seq_id", "contig_idx", "piece"], "ext_idx").collect()}
        assert {(r.seq_id, r.contig_idx, r.piece): len(r.blob) for r in blobs} == sizes
        df = spark.createDataFrame(blobs, codec.BLOB)
        back = codec.from_bytes(df)
        plain = lambda d: sorted((r.seq_id, r.ext_idx, r.kind, r.nid if r.kind == "TN" else None, r.base, r.nb if r.kind == "R" else 1, r.off) for r in d.collect())
        assert plain(back) == plain(ext) and set(own) <= set(back.columns)
        assert sorted(map(str, codec.to_bytes(back).collect())) == sorted(map(str, blobs))
        assert sorted(map(str, encode.decode(back, g).collect())) == sorted(map(str, encode.decode(ext, g).collect()))
        with pytest.raises(Exception, match="checksum"):
            codec.from_bytes(df.withColumn("blob", F.expr("substring(blob, 1, length(blob) - 1)"))).collect()
    blob = codec.pack(["TN", "TN", "R", "NN"], [0, (1 << 63) - 1, None, None], [None] * 3 + [2], [None, None, 70000, None], [None, None, 255, None])
    assert codec.unpack(blob) == [("TN", 0, None, 1, None), ("TN", (1 << 63) - 1, None, 1, None), ("R", None, None, 70000, 255), ("NN", None, 2, 1, None)]
    for wrong in (blob[:-1], blob + b"x", b"\x01\x03", b"\xff"):
        with pytest.raises(ValueError):
            codec.unpack(wrong)


def test_paths_from_both_ends(spark):
    """Random graphs: searches from both ends give the paths of a search from one end, and reach far fewer nodes."""
    rng = random.Random(5)
    n = 300
    steps = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(500)})
    edges = spark.createDataFrame([(a, b, i % 4) for i, (a, b) in enumerate(steps)], "src long, dst long, base int")
    after = {}
    for a, b in steps:
        after.setdefault(a, []).append(b)
    ball = 0

    def one_sided(a, b):
        nonlocal ball
        parent, front = {}, [a]
        while front:
            found = {}
            for v in front:
                for u in after.get(v, []):
                    if u not in parent and u not in found:
                        found[u] = v
            parent |= found
            ball += len(found)
            if b in found:
                path = [b]
                while parent[path[-1]] != a:
                    path.append(parent[path[-1]])
                return path[::-1]
            front = sorted(found)
        return None

    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(50)} | {(i, i) for i in range(10)})
    expect = {p: one_sided(*p) for p in pairs}
    g = paths.Adjacency.of(edges)
    assert {p: g.shortest(*p) for p in pairs} == expect and max(len(x or ()) for x in expect.values()) >= 10
    df, got = spark.createDataFrame(pairs, "src long, dst long"), {}
    for r in paths.shortest(edges, df).orderBy("i").collect():
        got.setdefault((r.src, r.dst), []).append(r.nid)
    assert got == {p: x for p, x in expect.items() if x}
    assert sum(t.count() for t in paths._meet(edges, df, None)[1][1:]) < ball / 3


def test_null_ids(spark):
    rows = [(None, 0, i, 7) for i in range(6)] + [("a", 0, i, i % 2) for i in range(8)] + [("", 0, i, i) for i in range(5)]
    w = spark.createDataFrame(rows, "seq_id string, contig_idx int, step int, nid long").repartition(1)
    got = {(r.seq_id, r.pos, r.run, r.offset) for r in encode.repetitions(w, encode.Params(min_rep=3)).collect()}
    assert got == {(None, 1, 5, 0), ("a", 2, 6, 1)}
