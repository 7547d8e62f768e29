"""Shortest paths between k-mers that are fewer than k steps apart: their ends overlap, so the bases of both spell the only path of each length.

K-mers and what asks for them are dealt as arrays by their hash, and answers by their pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import minimizers, paths
from strandloom.operators.graph import Graph
from strandloom.operators.minimizers import LIMB, _numbers, _planes
from strandloom.session import materialise, ship

#: Rows that are dealt at a time.
ROWS = 1 << 18
ASKED = "part int, kind int, lo binary, hi binary, ref binary, tag binary"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _tags(data: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint16).astype(np.int64)


def _codes(column: pa.Array, k: int) -> np.ndarray:
    """A row of codes for each k-mer."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return minimizers._CODES[np.frombuffer(column.buffers()[2], np.uint8)[at : at + k * len(column)]].reshape(-1, k)


def _limbs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        if i >= LIMB:
            hi = hi << np.uint64(2) | lo >> np.uint64(62)
        lo = lo << np.uint64(2) | codes[:, i]
    return hi, lo


def _by_part(part: np.ndarray, columns: list[np.ndarray | None], kind: int | None) -> pa.RecordBatch:
    """One row a part: its number, the kind if there is one, and each column's values there as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    spans = list(zip(head.tolist(), [*head[1:].tolist(), len(part)], strict=True))
    sorted_ = [None if c is None else np.ascontiguousarray(c[order]) for c in columns]
    data = [pa.array([b"" if c is None else _planes(c[a:z]) if c.itemsize == 8 else c[a:z].tobytes() for a, z in spans], pa.binary()) for c in sorted_]
    first = [pa.array(part[head].astype(np.int32)), *([] if kind is None else [pa.array(np.full(len(head), kind, np.int32))])]
    return pa.RecordBatch.from_arrays([*first, *data], names=[str(i) for i in range(len(first) + len(data))])


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _asked(k: int, parts: int):
    """For each pair, both its k-mers (steps 0 and 1 of length 0) and the k-mers between them for each length by which they overlap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            a, z, ref = _codes(b.column("a"), k), _codes(b.column("z"), k), b.column("ref").to_numpy()
            for d in range(k):
                if d:
                    rows = np.flatnonzero((a[:, d:] == z[:, : k - d]).all(1))
                    path = np.concatenate((a[rows], z[rows, k - d :]), axis=1)
                    steps = [(i, path[:, i : i + k]) for i in range(1, d)] or [(1, None)]
                else:
                    rows, steps = np.arange(len(a)), [(0, a), (1, z)]
                if not len(rows):
                    continue
                for i, codes in steps:
                    # A length of one step has nothing between: it is answered by the k-mer it starts from.
                    hi, lo = _limbs(a[rows] if codes is None else codes)
                    part = ((lo ^ hi) * MIX >> np.uint64(33)) % np.uint64(parts)
                    yield _named(_by_part(part, [lo, hi if k > LIMB else None, ref[rows], np.full(len(rows), d << 8 | i, np.uint16)], 1))

    return run


def _named(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(b.columns, names=["part", "kind", "lo", "hi", "ref", "tag"])


def _nodes(k: int, parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            hi, lo = _limbs(_codes(b.column("seq"), k))
            part = ((lo ^ hi) * MIX >> np.uint64(33)) % np.uint64(parts)
            yield _named(_by_part(part, [lo, hi if k > LIMB else None, b.column("nid").to_numpy(), None], 0))

    return run


def _answered(k: int, parts: int):
    """The nodes of a task's k-mers to those that ask for them; of two nodes with one k-mer the forward one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("kind", "lo", "hi", "ref", "tag")], strict=True)]
        lo, hi, ref = ([_numbers(r[c] for r in rows if r[0] == kind).view(np.uint64 if c < 3 else np.int64) for kind in (0, 1)] for c in (1, 2, 3))
        tag = _tags(r[4] for r in rows if r[0] == 1)
        hi = [h if len(h) else np.zeros(len(x), np.uint64) for h, x in zip(hi, lo, strict=True)]
        # Nodes first among equals, forward ones first among them: the last node at or before a question is looked at.
        side = np.concatenate((1 - ref[0] % 2, np.full(len(tag), 2)))
        h, x = np.concatenate(hi), np.concatenate(lo)
        order = np.lexsort((side, x, h) if k > LIMB else (side, x))
        h, x, is_node = h[order], x[order], order < len(ref[0])
        last = np.maximum.accumulate(np.where(is_node, np.arange(len(order)), -1))
        asks = np.flatnonzero(~is_node & (last >= 0))
        asks = asks[(x[last[asks]] == x[asks]) & (h[last[asks]] == h[asks])]
        node, which = ref[0][order[last[asks]]], order[asks] - len(ref[0])
        by = np.argsort(ref[1][which])  # neighbours are alike, so the shuffle packs them better
        node, which = node[by], which[by]
        for at in range(0, len(which), ROWS):
            pair, steps = ref[1][which[at : at + ROWS]], tag[which[at : at + ROWS]].astype(np.uint16)
            part = (pair.view(np.uint64) * MIX >> np.uint64(33)) % np.uint64(parts)
            b = _by_part(part, [pair, steps, node[at : at + ROWS]], None)
            yield pa.RecordBatch.from_arrays(b.columns, names=["part", "pair", "tag", "nid"])

    return run


def _chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst, nids) of each pair that has both: the nodes of its shortest path, dst last; null if no length is answered in full."""
    rows = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("pair", "tag", "nid")], strict=True)]
    pair, tag, nid = _numbers(r[0] for r in rows), _tags(r[1] for r in rows), _numbers(r[2] for r in rows)
    order = np.lexsort((tag, pair))
    pair, d, i, nid = pair[order], tag[order] >> 8, tag[order] & 255, nid[order]
    if not len(pair):
        return
    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (d[1:] != d[:-1]))))
    n = np.diff(np.append(new, len(pair)))
    ends = new[(d[new] == 0) & (n == 2)]  # pairs with both of their k-mers
    full = new[(d[new] > 0) & (n == np.maximum(d[new] - 1, 1))]
    full = full[np.concatenate(([True], pair[full][1:] != pair[full][:-1]))] if len(full) else full
    at = np.searchsorted(pair[full], pair[ends]) if len(full) else np.zeros(len(ends), np.int64)
    has = (at < len(full)) & (pair[full[np.minimum(at, len(full) - 1)]] == pair[ends]) if len(full) else np.zeros(len(ends), bool)
    for s in range(0, len(ends), ROWS // 8):
        e, known = ends[s : s + ROWS // 8], has[s : s + ROWS // 8]
        f = full[at[s : s + ROWS // 8][known]]
        length = np.zeros(len(e), np.int64)
        length[known] = d[f]
        offsets = np.concatenate(([0], np.cumsum(length)))
        nodes = np.empty(offsets[-1], np.int64)
        inner = length[known] - 1
        nodes[minimizers._gathered(offsets[:-1][known], inner)] = nid[minimizers._gathered(f, inner)]
        nodes[offsets[1:][known] - 1] = nid[e[known] + 1]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(nodes), mask=pa.array(~known))
        yield pa.RecordBatch.from_arrays([pa.array(nid[e]), pa.array(nid[e + 1]), lists], names=["src", "dst", "nids"])


def shortest(graph: Graph, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """paths.shortest of the nodes of k-mers (a, z) in a graph whose nodes are k-mers: (src, dst, i, nid). Pairs with a k-mer that is no node have no rows.

    A path of d < k steps ends in the last d bases of z after those of a, so it is there if the two overlap by k - d bases and all k-mers between are
    nodes: each is asked for once, and no neighbour is searched. Only pairs without such a path are searched from both ends.
    """
    spark, k = pairs.sparkSession, graph.k
    if k > minimizers.WIDEST:
        raise ValueError(f"k-mers have at most {minimizers.WIDEST} bases")
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialise(pairs.where((F.length("a") == k) & (F.length("z") == k) & ~F.contains(F.concat("a", "z"), F.lit("N"))).select("a", "z").distinct(), "kmer-pairs").withColumn("ref", F.monotonically_increasing_id())
    asked = pairs.mapInArrow(_asked(k, 8 * n), ASKED).unionByName(graph.oriented().mapInArrow(_nodes(k, 8 * n), ASKED))
    told = asked.repartition(4 * n, "part").select("kind", "lo", "hi", "ref", "tag").mapInArrow(_answered(k, 8 * n), "part int, pair binary, tag binary, nid binary")
    found = told.repartition(4 * n, "part").select("pair", "tag", "nid").mapInArrow(_chosen, "src long, dst long, nids array<long>")
    found = materialise(found, "near-paths")
    most = k - 1 if max_depth is None else max_depth
    near = found.where(F.size("nids").between(1, most)).select("src", "dst", F.posexplode("nids").alias("i", "nid")).select("src", "dst", (F.col("i") + 1).alias("i"), "nid")
    far = found.where("nids is null").select("src", "dst")
    if far.isEmpty() or max_depth is not None and max_depth < k:
        return near
    return near.unionByName(paths.shortest(graph.edge_table(), far, max_depth))
