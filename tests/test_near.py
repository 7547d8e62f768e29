"""Shortest paths by the overlaps of their ends, against the search from both ends."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandloom.operators import near, paths
from strandloom.operators.graph import Graph
from strandloom.plans import registry
from strandloom.session import scratch_root


@pytest.mark.parametrize(("k", "stranded", "size"), [(4, False, 40), (5, True, 90), (35, True, 60)])
def test_near_and_far(spark, k, stranded, size):
    """Ways round cycles, from a k-mer to itself, palindromes, pairs that are far apart or have no path, and k-mers that are no nodes."""
    rng = random.Random(k)
    seq = "".join(rng.choices("ACGT", k=size)) + "ACGT" * 12
    df = spark.createDataFrame([("a", seq), ("b", seq[10 : 10 + k] + "ACCA" + "T" * k)], "seq_id string, seq string")
    g = Graph.from_sequences(df, ["seq_id"], k, stranded).materialised()
    found = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    pairs = [(rng.choice(found), rng.choice(found)) for _ in range(25)] + [(x, x) for x in found[-6:]] + [(found[i], found[i + d]) for i in (0, 3) for d in (1, 2, k - 1, k, k + 1)]
    pairs += [("G" * k, found[0]), (found[0], "G" * k), ("N" * k, found[0]), (found[0], "T" * k), (found[0], None)]
    pairs = spark.createDataFrame(pairs, "a string, z string")
    ends = g.ends().where("side = 'L'").select(F.col("kmer"), "nid")
    known = pairs.join(ends.toDF("a", "src"), "a").join(ends.toDF("z", "dst"), "z").select("src", "dst").distinct()
    for depth in (None, 2) if k < 6 else (k + 3,):
        got, want = near.shortest(g, pairs, depth).collect(), paths.shortest(g.edge_table(), known, depth).collect()
        assert len(got) == len(want) and set(got) == set(want)


def test_query_searches_no_neighbours(spark):
    """Paths of 12 steps between 13-mers need no table of edges and no level of a search, so few tables are written."""
    root = Path(scratch_root(spark).removeprefix("file:")) / "strandloom"
    before = set(root.glob("*"))
    assert registry.QUERIES["shortest_path_bidirectional"](spark, "/root/testdata/sf0.001").count()
    assert not [p.name for p in root.glob("*") if p not in before and p.name.startswith(("edges", "level", "front", "steps"))]
