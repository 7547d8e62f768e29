"""Walks in blocks against walks in one task."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import encode, parse
from strandloom.operators.encode import Params
from strandloom.operators.graph import Graph
from strandloom.session import scratch

WALKS = "seq_id string, contig_idx int, step int, nid long"


def walk_rows(name, idx, nodes):
    return [(name, idx, i, n) for i, n in enumerate(nodes)]


@pytest.mark.parametrize(("block", "params"), [(1, Params(min_rep=3, max_offset=4)), (7, Params(min_rep=2, max_offset=0)), (16, Params(min_rep=4, max_offset=11)), (1 << 16, Params())])
def test_repetitions(spark, block, params):
    """Runs over many blocks, of one offset after another, up to a walk's end; walks of one node; a null id."""
    rng = random.Random(block)
    rows = walk_rows("a", 0, [3] * 90) + walk_rows("a", 1, [5]) + walk_rows(None, 0, [1, 2, 3, 4] * 20 + [9, 9]) + walk_rows("e", 0, [1, 2])
    for i in range(6):
        nodes = []
        while len(nodes) < 120:
            nodes += [rng.randrange(3)] if rng.random() < 0.5 or len(nodes) < 12 else nodes[-rng.randrange(1, 12) :] * rng.randrange(1, 5)
        rows += walk_rows("r", i, nodes)
    walks = spark.createDataFrame(rows, WALKS).repartition(3)
    of = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert of(parse.repetitions(walks, params, block)) == of(encode.repetitions(walks, params))


@pytest.mark.parametrize(("block", "params"), [(1, Params(min_sp=2, max_sp=3, min_rep=3, max_offset=4)), (16, Params(min_sp=4, max_sp=12, min_rep=5, max_offset=9)), (40, Params(min_sp=99, max_sp=9, min_rep=6, max_offset=20))])
def test_greedy(spark, block, params):
    """The same extensions, anchors and numbers too: gaps and repetitions of many blocks, nucleotides only, a null id."""
    rng = random.Random(block)
    nodes = [(2 * i, 2 * j) for i in range(30) for j in sorted({(i + 1) % 30, *([rng.randrange(30)] if i % 3 == 0 else [])})]
    base = {}
    edges = [(s, base.setdefault(s, 0) or 0, d) for s, d in nodes]
    edges = [(s, sum(1 for x in edges[:i] if x[0] == s), d) for i, (s, _, d) in enumerate(edges)]
    after = {}
    for s, _, d in edges:
        after.setdefault(s, []).append(d)

    class Fixed(Graph):
        def edge_table(self):
            return spark.createDataFrame(edges, "src long, base int, dst long").select("src", "dst", F.col("base"))

    graph = Fixed(spark.createDataFrame([], "id long, seq string"), 5, True)
    rows = walk_rows("one", 0, [0]) + walk_rows("two", 0, [0, 2])
    for i, name in enumerate(["a", "a", None, "b"]):
        path = [rng.choice(list(after))]
        while len(path) < 400:
            back = path[-rng.randrange(1, 9) :]
            if rng.random() < 0.03 and back[0] in after[path[-1]]:
                path += back * rng.randrange(1, 12)
            path.append(rng.choice(after[path[-1]]))
        rows += walk_rows(name, i, path)
    walks = spark.createDataFrame(rows, WALKS).repartition(3)
    of = lambda df: sorted(map(str, (tuple(r) for r in df.select(*[c.split()[0] for c in encode.EXT.split(", ")]).collect())))
    with scratch(spark):
        got, want = of(parse.greedy(walks, graph, params, block)), of(encode.greedy(walks, graph, params))
    assert got == want


def test_prefix_looks_no_further_than_the_distance():
    """In a ring of nodes that all branch, the search for a prefix doesn't spread over the graph, and has the length that counting all ways gives."""
    import numpy as np

    from strandloom.operators.paths import Adjacency

    rng = random.Random(2)
    n = 1 << 16
    after = [sorted({(i + 1) % n, *(rng.randrange(n) for _ in range(2))}) for i in range(n)]
    src, to = (np.array(x) for x in zip(*[(i, j) for i, x in enumerate(after) for j in x], strict=True))
    starts = lambda x: np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n)))).astype(np.int64)
    back = np.argsort(to, kind="stable")
    g = Adjacency(starts(src), to, np.zeros(len(to), np.int8), starts(to), src[back])
    seen = []
    asked = Adjacency.after
    g.after = lambda v: seen.append(v) or asked(g, v)

    def plain(path, most):
        ways, met = {path[0]: 1}, set()
        for d in range(1, most + 1):
            found = {}
            for v, w in ways.items():
                for u in after[v]:
                    if u not in met:
                        found[u] = 2 if u in found else w
            if found.get(path[d]) != 1:
                return max(1, d - 1)
            met |= found.keys()
            ways = found
        return most

    for start in range(0, 300, 20):
        path = [start + i for i in range(40)]
        for most in (1, 2, 3, 7, 39):
            assert g.prefix(path, 0, most) == plain(path, most)
    seen.clear()
    g.prefix(list(range(500, 540)), 0, 39)
    assert len(seen) < 3000
