"""K-mers as two longs, counting and chaining by minimizers, against plain versions on strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import minimizers
from strandloom.operators.graph import Graph

BACK = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(BACK)


def value(s):
    out = 0
    for c in s:
        out = out * 4 + "ACTG".index(c)
    return out


@pytest.mark.parametrize("k", [2, 11, 31, 32, 33, 47, 63])
def test_limbs(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=k)) for _ in range(40)] + ["G" * k, "A" * k, "T" * k]
    hi, lo = S.limbs(F.col("s"), k)
    df = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", hi.alias("hi"), lo.alias("lo"))
    h, x = F.col("hi"), F.col("lo")
    forms = {"same": (h, x), "back": S.revcomp_limbs(h, x, k), "right": S.extend_limbs_right(h, x, F.lit(3), k), "left": S.extend_limbs_left(h, x, F.lit(2), k)}
    for r in df.select("s", "hi", "lo", *[S.unpack_limbs(a, b, k).alias(n) for n, (a, b) in forms.items()]).collect():
        assert (r.hi << 64) + r.lo % (1 << 64) == value(r.s) and r.hi >= 0
        assert (r.same, r.back, r.right, r.left) == (r.s, rc(r.s), r.s[1:] + "G", "T" + r.s[:-1])
    text = "".join(seqs)
    codes = np.array(["ACTG".index(c) for c in text], np.uint8)
    for back in (False, True):
        a, b = minimizers.limbs(codes, k, back)
        assert [(int(p) << 64) + int(q) for p, q in zip(a, b, strict=True)] == [value(rc(text[i : i + k]) if back else text[i : i + k]) for i in range(len(text) - k + 1)]
    m = minimizers.width(k)
    canon = minimizers.minimizers(codes, k, m, True)
    assert np.array_equal(canon, minimizers.minimizers((codes ^ 2)[::-1], k, m, True)[::-1])  # both strands have the same ones


def nodes_brute(seqs, k, stranded):
    """k-mers in the orientation and order of their first occurrence, and how often they occur."""
    first, n = {}, {}
    for _, s in sorted(seqs):
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            if "N" not in x:
                key = x if stranded else min(x, rc(x))
                first.setdefault(key, x)
                n[key] = n.get(key, 0) + 1
    return list(first.values()), [n[key] for key in first]


def unitigs_brute(nodes, k, stranded):
    """Sequences of maximal chains, each once; cycles begin at the node that is first in `nodes`, in its orientation there."""
    every = nodes if stranded else [y for x in nodes for y in (x, rc(x))]
    begins, ends = {}, {}
    for x in every:
        begins.setdefault(x[: k - 1], []).append(x)
        ends.setdefault(x[1:], []).append(x)
    after = {}
    for j, e in ends.items():
        b = begins.get(j, [])
        if len(e) == len(b) == 1 and e[0] != b[0] and (stranded or b[0] != rc(e[0])):
            after[e[0]] = b[0]
    heads = [x for x in every if x not in set(after.values())]
    out, seen = set(), set()

    def chain(x):
        s, first = x, x
        seen.add(x)
        while x in after and after[x] != first:
            x = after[x]
            seen.add(x)
            s += x[-1]
        return s

    for x in heads:
        s = chain(x)
        out.add(s if stranded else min(s, rc(s)))
    for x in nodes:
        if x not in seen and (stranded or rc(x) not in seen):
            s = chain(x)
            out.add(s if stranded else min(s, rc(s)))
    return sorted(out)


CASES = [(5, False), (6, True), (31, False), (47, False), (63, True), (66, False)]


@pytest.mark.parametrize(("k", "stranded"), CASES)
def test_counts_and_unitigs(spark, k, stranded, monkeypatch):
    rng = random.Random(k)
    base = "".join(rng.choices("ACGT", k=400))
    ring = "".join(rng.choices("ACGT", k=k + 15))
    seqs = [("a", base), ("b", base[50:150] + "N" + rc(base[200:330])), ("c", "N" * 5), ("d", "ACG"), ("e", "A" * (2 * k)), ("f", base[:90] + "".join(rng.choices("ACGT", k=80)) + base[120:200]), ("g", ring + ring[:k])]
    seqs += [(f"h{i}", "AC" * k) for i in range(3)]
    df = spark.createDataFrame(seqs, "seq_id string, seq string").repartition(3)
    nodes, n = nodes_brute(seqs, k, stranded)
    g = Graph.from_sequences(df, ["seq_id"], k, stranded).materialised()
    assert [r.seq for r in g.unitigs.orderBy("id").collect()] == nodes
    if k <= minimizers.WIDEST:
        monkeypatch.setattr(minimizers, "BLOCK", 50)  # minimizers that are larger than a block
        assert [r.n for r in minimizers.counts(df, ["seq_id"], k, not stranded).orderBy("first").collect()] == n
        monkeypatch.undo()
    twice = Graph.from_sequences(df, ["seq_id"], k, stranded, 2)
    assert [r.seq for r in twice.unitigs.orderBy("id").collect()] == [x for x, c in zip(nodes, n, strict=True) if c > 1]
    assert sorted(r.seq for r in g.compacted().unitigs.collect()) == unitigs_brute(nodes, k, stranded)


def test_canonical_cycles(spark):
    """A cycle and its reverse are one unitig, cut at one place."""
    rng = random.Random(9)
    rings = ["".join(rng.choices("ACGT", k=24)) for _ in range(4)]
    df = spark.createDataFrame([(str(i), r + r[:9]) for i, r in enumerate(rings)], "seq_id string, seq string")
    for stranded in (True, False):
        u = Graph.from_sequences(df, ["seq_id"], 9, stranded).compacted().materialised()
        got = [r.seq for r in u.unitigs.collect()]
        assert len(got) == 4 and {len(x) for x in got} == {32} and u.duplicate_ends().isEmpty()
        assert u.stats().first().nodes == 4
        doubled = [r + r for r in rings]
        assert all(any(x[:24] in d or x[:24] in rc(d) for d in doubled) for x in got)


def test_hash_aggregates(spark):
    """The counts of k-mers and the joints of nodes need no sort."""
    df = spark.createDataFrame([("a", "ACGTTGCA" * 20)], "seq_id string, seq string")
    text = lambda x: x._jdf.queryExecution().executedPlan().toString()
    g = Graph.from_sequences(df, ["seq_id"], 31, False)
    joints = text(minimizers.joints(g.oriented(), 31, True))
    assert "HashAggregate" in joints and "SortAggregate" not in joints and "SortAggregate" not in text(minimizers.counts(df, ["seq_id"], 47, True))


@pytest.mark.parametrize("k", [9, 31, 47])
def test_totals_write_one_shuffle(spark, k, monkeypatch):
    """K-mers and how often, alphabetically the smaller of both strands, in passes too; nothing is written on the way, and super-k-mers carry no places."""
    from pathlib import Path

    from strandloom.session import scratch_root

    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=900)) for _ in range(6)] + ["A" * 300, "AC" * 80 + "N" + "T" * 200, "ACG", "", None]
    seqs += [rc(seqs[0]), seqs[1][:100] + "N" + seqs[2][:k]]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    want = {}
    for s in seqs:
        for x in (s[i : i + k] for i in range(len(s or "") - k + 1)):
            if "N" not in x:
                want[min(x, rc(x))] = want.get(min(x, rc(x)), 0) + 1
    written = lambda: len(list((Path(scratch_root(spark).removeprefix("file:")) / "strandloom").glob("*")))
    before = written()
    for block in (1 << 20, 100):
        monkeypatch.setattr(minimizers, "BLOCK", block)
        rows = minimizers.totals(df, k, True).collect()
        assert len(rows) == len(want) and {r.kmer: r.n for r in rows} == want
    assert written() == before


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_chains_by_rounds_or_at_once(spark, few, monkeypatch):
    """Long chains of stretches and rings: the few that are left are chained at once, with the result of the rounds of joins."""
    from pathlib import Path

    from strandloom.operators import graph
    from strandloom.session import scratch_root

    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(8)
    ring = "".join(rng.choices("ACGT", k=400))
    seqs = [("a", "".join(rng.choices("ACGT", k=1500))), ("b", ring + ring[:20]), ("c", "".join(rng.choices("ACGT", k=90)))]
    root = Path(scratch_root(spark).removeprefix("file:")) / "strandloom"
    before = set(root.glob("chain-*"))
    monkeypatch.setattr(minimizers, "BLOCK", 5)  # stretches of a few joints
    for stranded in (True, False):
        g = Graph.from_sequences(spark.createDataFrame(seqs, "seq_id string, seq string"), ["seq_id"], 15, stranded).compacted()
        nodes = nodes_brute(seqs, 15, stranded)[0]
        got = {r.seq for r in g.unitigs.collect()}
        assert got == set(unitigs_brute(nodes, 15, stranded)) or {min(x, rc(x)) for x in got} == {min(x, rc(x)) for x in unitigs_brute(nodes, 15, stranded)}
    assert few == 0 or len(set(root.glob("chain-*")) - before) <= 4
