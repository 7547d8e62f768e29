"""N-gram Jaccard join: a size-aware heavy-light join over word shingles, exact at its threshold of 0.8.

Sets are the distinct 5-word shingles of a text. Equal sets are one class, found by 128-bit hashes; classes are joined:

* Small sets enumerate subsets. For sizes a and b a link means at least c(a, b) = ceil(4 (a + b) / 9) common shingles, so sets
  of a pair of sizes that emit an equal subset of c elements are linked, with nothing to verify and no pairs to list.
* Large sets are scanned in inverted lists over a prefix of n - ceil(0.8 n) + 1 shingles, light ones first. A shingle is
  heavy if more than `limit` classes have it, so the lists that are scanned are short. Pairs that share enough of them to link at
  all are candidates.
* Sets whose prefix reaches heavy shingles (large groups of similar texts) also enumerate subsets. What links of such sets is still to
  be found has no light shingle in common, so light ones count as differences, and the heavy ones may differ only in what
  is left: the budget. They are dealt into more parts than that, so most parts of the two are equal, and one of them
  is among the budget + 1 rarest parts of either. Such parts meet; a group is linked through its most central member
  first, and only what is left in different components is compared pair by pair, where the distances of the two to the same
  central member leave room for a link (triangle inequality).

The boundaries are set by cost: `limit` weighs comparing the members of a list against emitting their parts, the
largest small size weighs its subsets against its prefix and the lists found there. Heavy shingles are kept as one bit map whose
size follows their number up to a bound; a false bit moves a shingle to the end of the order everywhere alike and loses no link. Counts and prefixes
travel as sorted, difference-coded arrays, one per hash range and task, so whole sets never do, except those of candidates.

Defined cases: null and empty texts have empty sets and link with nothing; rows with a null id have no component and link with
nothing; rows that share an id count as one document. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.components import components
from strandloom.llm.skew import join_counted
from strandloom.llm.worker import tidy
from strandloom.session import materialise, ship

SHINGLE = 5
#: Ids up to this number are broadcast; texts are shuffled to meet more of them.
BROADCAST_IDS = 2_000_000
FLUSH = 2_000_000
MAX_SMALL = 12
PAIR_COST = 8  # comparing a pair, in emitted parts

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def overlap(a: int, b: int) -> int:
    """Least number of common shingles of linked sets of these sizes."""
    return -(-4 * (a + b) // 9)


def prefix_size(n):
    return n - -(-4 * n // 5) + 1


def sets(data: np.ndarray, off: np.ndarray):
    """(row of each element, element), rows and elements ascending, in blocks of whole rows with (first row, row after the last)."""
    for row, last, rows, _, _, h in W.word_blocks(data, off, W.NONSPACE):
        counts = np.bincount(rows - row, minlength=last - row)
        first, x = W.windows(rows, h, SHINGLE)
        of = [rows[first]]
        xs = [x]
        for k in range(1, SHINGLE):
            own = np.flatnonzero(counts[rows - row] == k)
            if len(own):
                first, x = W.windows(rows[own], h[own], k)
                of.append(rows[own][first])
                xs.append(x)
        of, x = np.concatenate(of), np.concatenate(xs)
        order = np.lexsort((x, of))
        of, x = of[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1])
        yield row, last, of[new], x[new]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def _sizes(batches):
    for b in batches:
        data, off = W.raw(b.column("text"))
        n, ha, hb = np.zeros(len(b), np.int64), np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
        for _, _, of, x in sets(data, off):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            at = of[starts]
            n[at] = np.diff(np.append(starts, len(of)))
            ha[at], hb[at] = _sums(W.mix(x), starts), _sums(W.mix(x ^ _GOLD), starts)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(ha.view(np.int64)), pa.array(hb.view(np.int64))], names=["id", "n", "ha", "hb"])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def map_bits(total: int) -> int:
    """log2 of the heavy map's size for a number of shingles: 8 MB for up to 2 billion, then more, up to 128 MB. A map that is too full costs time, not links."""
    return min(30, max(26, int(total).bit_length() - 5))


def head_bits(total: int) -> int:
    """Bits of a shingle's hash by which it is counted: 32 for up to 2 billion shingles; with all 64 no two are taken for one beyond that."""
    return 32 if total < 1 << 31 else 64


def _counted(log_blocks: int, head: int):
    """(block, sorted shingle heads of `head` bits as differences, counts up to 255) of the rows of a task."""
    kind, shift = np.dtype(f"<u{head // 8}"), np.uint64(64 - head)

    def flush(held):
        x = np.concatenate(held)
        held.clear()
        x.sort()
        edges = np.searchsorted(x, (np.arange(1 << log_blocks, dtype=np.uint64) << np.uint64(head - log_blocks)).astype(kind))
        edges = np.append(edges, len(x))
        out = []
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if z > a:  # block by block, so the arrays that unique needs are small
                u, n = np.unique(x[a:z], return_counts=True)
                out.append((i, _planes(np.diff(u, prepend=kind.type(0))), np.minimum(n, 255).astype(np.uint8).tobytes()))
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "heads", "counts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, _, _, x in sets(*W.raw(b.column("text"))):
                held.append((x >> shift).astype(kind))
                size += len(x)
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _heavy(log_blocks: int, limit: int, head: int, map_log: int):
    """Per block of shingle heads: the bits of those that more than limit classes have, and sums for the cost model."""
    kind, width = np.dtype(f"<u{head // 8}"), 1 << (map_log - log_blocks)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        heads = np.concatenate([np.cumsum(_unplaned(x.as_py(), kind.str), dtype=kind) for x in table.column("heads")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
        order = np.argsort(heads, kind="stable")
        heads, counts = heads[order], counts[order]
        del order
        starts = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1))
        df = np.add.reduceat(counts, starts, dtype=np.int64)
        bits = np.zeros(width, bool)
        bits[(heads[starts[df > limit]].astype(np.uint64) >> np.uint64(head - map_log)).astype(np.int64) - block * width] = True
        light = df[df <= limit]
        return pa.table({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "n1": pa.array([int(light.sum())]), "n2": pa.array([int(light @ light)])})

    return run


def _is_heavy(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = (x >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _subset_keys(x: np.ndarray, small: int):
    """(key, side) of every subset by which a set meets a set where the smaller of the two has at most `small` elements; side: 0 smaller, 1 larger, 2 equal."""
    n, out = len(x), []
    mixed = [int(v) for v in W.mix(x)]
    for other in range(-(-4 * n // 5), 5 * n // 4 + 1):
        a, b = min(n, other), max(n, other)
        if a < 1 or a > small:
            continue
        tag = (a * 64 + b) * 0x9E3779B97F4A7C15
        for part in combinations(mixed, overlap(a, b)):
            out.append(((sum(part) + tag) & ((1 << 64) - 1), 2 if n == other else int(n > other)))
    return out


_FIELDS = {"kind": pa.string(), "block": pa.int32(), "keys": pa.binary(), "nodes": pa.binary(), "sizes": pa.binary(), "node": pa.int64(), "key": pa.int64()}
_FOUND = "kind string, block int, keys binary, nodes binary, sizes binary, node long, key long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_FIELDS.values())], names=list(_FIELDS))


def _postings(bitmap, small: int, log_blocks: int):
    """Light prefix shingles by block ('list'), how many of its n each set has there ('set': block and key), subset keys of small sets ('small': block is the side), ids of sets with heavy prefix shingles ('heavy')."""

    def flush(held):
        key, node, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(key, kind="stable")
        key = key[order]
        node = node[order]
        n = n[order]
        edges = np.append(np.searchsorted(key, np.arange(1 << log_blocks, dtype=np.uint64) << np.uint64(48 - log_blocks)), len(key))
        return [("list", i, _planes(np.diff(key[a:z], prepend=np.uint64(0))), _planes(node[a:z]), _planes(n[a:z]), None, None) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        held, size = [], 0
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for row, last, of, x in sets(*W.raw(b.column("text"))):
                n = np.bincount(of - row, minlength=last - row)
                heavy = _is_heavy(bits, x)
                order = np.lexsort((x, heavy, of))
                of2, x2, heavy2 = of[order], x[order], heavy[order]
                starts = np.concatenate(([0], np.cumsum(n)))
                rank = np.arange(len(x2)) - starts[of2 - row]
                inside = (rank < prefix_size(n)[of2 - row]) & (n[of2 - row] > small)
                light = inside & ~heavy2
                emitted = np.bincount((of2 - row)[light], minlength=last - row)
                out += [("set", int(emitted[r]), None, None, None, int(ids[row + r]), int(n[r])) for r in np.flatnonzero(emitted)]
                out += [("heavy", None, None, None, None, int(i), None) for i in ids[np.unique(of2[inside & heavy2])]]
                held.append((x2[light] >> np.uint64(16), ids[of2[light]], n[of2[light] - row].astype(np.uint32)))
                size += int(light.sum())
                for r in np.flatnonzero((n > 0) & (4 * n <= 5 * small)):
                    for key, side in _subset_keys(x[starts[r] : starts[r + 1]], small):
                        out.append(("small", side, None, None, None, int(ids[row + r]), key - (1 << 64) if key >> 63 else key))
                if size > FLUSH:
                    out += flush(held)
                    held, size = [], 0
            if out:
                yield _found(out)
        if size:
            yield _found(flush(held))

    return run


def _listed(table: pa.Table) -> pa.Table:
    """Pairs (a < b) of sets in the same inverted list whose sizes allow a link, and in how many lists of the block."""
    key = np.concatenate([np.cumsum(_unplaned(x.as_py(), "<u8"), dtype=np.uint64) for x in table.column("keys")])
    node = np.concatenate([_unplaned(x.as_py(), "<i8") for x in table.column("nodes")])
    n = np.concatenate([_unplaned(x.as_py(), "<u4") for x in table.column("sizes")]).astype(np.int64)
    order = np.lexsort((node, key))
    key, node, n = key[order], node[order], n[order]
    same = key[1:] == key[:-1]
    keep = np.zeros(len(key), bool)
    keep[1:] |= same
    keep[:-1] |= same
    key, node, n = key[keep], node[keep], n[keep]
    pairs, step = [np.zeros((0, 2), np.int64)], 1
    while step < len(key):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            break
        a, b = n[at], n[at + step]
        ok = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (node[at] != node[at + step])
        pairs.append(np.stack((node[at][ok], node[at + step][ok]), 1))
        step += 1
    u, c = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    return pa.table({"a": pa.array(u[:, 0]), "b": pa.array(u[:, 1]), "c": pa.array(c.astype(np.int64))})


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)


def largest(k):
    """The largest size of class k, or a little more."""
    return np.ceil(1.25 ** (np.asarray(k) + 1.0)).astype(np.int64)


def _parts(bitmap):
    """(key, node, n, light, grp, budget) for every part of the heavy shingles of every set, for two groups of pairs: with its own size class or the next, and with the one below."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, last, of, x in sets(*W.raw(b.column("text"))):
                n = np.bincount(of - row, minlength=last - row)
                heavy = _is_heavy(bits, x)
                light = np.bincount((of - row)[~heavy], minlength=last - row)
                mine, x = (of - row)[heavy], x[heavy]
                own = size_class(np.maximum(n, 1))
                out = []
                for back in (0, 1):
                    grp = own - back
                    parts = (largest(grp) + largest(grp + 1)) // 9 + 2  # one more than any budget needs: fewer, larger parts meet by chance less often
                    other = np.minimum(5 * n // 4, largest(grp + 1) if back == 0 else largest(grp))
                    budget = (n + other) // 9 - light
                    base = np.concatenate(([0], np.cumsum(parts)))
                    spread = W.mix(x + grp[mine].astype(np.uint64) * _GOLD) >> np.uint64(32)
                    cell = base[mine] + ((spread * parts[mine].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                    total = np.zeros(base[-1], np.uint64)
                    np.add.at(total, cell, W.mix(x ^ _GOLD))
                    owner = np.repeat(np.arange(last - row), parts)
                    at = np.flatnonzero(((n > 0) & (budget >= 0))[owner])
                    o = owner[at]
                    place = (at - base[o]).astype(np.uint64) + grp[o].astype(np.uint64) * np.uint64(1 << 32)
                    out.append((W.mix(total[at] + W.mix(place)).view(np.int64), ids[row + o], n[o], light[o], grp[o], budget[o]))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["key", "node", "n", "light", "grp", "budget"])

    return run


def _arrays(bitmap):
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            for row, last, of, x in sets(*W.raw(b.column("text"))):
                heavy = _is_heavy(bits, x)
                lists = []
                for part in (~heavy, heavy):
                    n = np.bincount((of - row)[part], minlength=last - row)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(x[part].view(np.int64))))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(row, last - row), *lists], names=["node", "light", "heavy"])

    return run


def _only(rows: DataFrame, ids: DataFrame, how: str, broadcast: int) -> DataFrame:
    """rows whose id is (left_semi) or isn't (left_anti) in ids; ids are broadcast while they are few."""
    ids = ids.select(F.col(ids.columns[0]).alias("id"))
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast else ids, "id", how)


def small_limit(n1: int, n2: int) -> int:
    """The largest size for which enumerating subsets costs less than a prefix and the lists it leads to."""
    mean = n2 / n1 if n1 else 1.0
    best = 0
    for n in range(1, MAX_SMALL + 1):
        subsets = sum(comb(n, overlap(n, m)) for m in range(-(-4 * n // 5), 5 * n // 4 + 1))
        if subsets <= prefix_size(n) * (2 + PAIR_COST * (mean - 1)) or n <= 4:
            best = n
    return best


LINK = "100 * (cl + ch) >= 80 * (n_a + n_b - cl - ch)"


def _met(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """pairs (a, b) with their sizes n_a and n_b, numbers of heavy elements h_a and h_b, and common light (cl) and heavy (ch) ones, by whole sets."""
    x = elements.select(F.col("node").alias("a"), F.col("light").alias("xl"), F.col("heavy").alias("xh"))
    y = elements.select(F.col("node").alias("b"), F.col("light").alias("yl"), F.col("heavy").alias("yh"))
    both = pairs.join(y, "b").join(x, "a")  # b may be a hub of very many pairs, which meet it as ids only
    return both.select(
        "a", "b", F.size("xh").alias("h_a"), F.size("yh").alias("h_b"), (F.size("xl") + F.size("xh")).alias("n_a"), (F.size("yl") + F.size("yh")).alias("n_b"),
        F.size(F.array_intersect("xl", "yl")).alias("cl"), F.size(F.array_intersect("xh", "yh")).alias("ch"),
    )


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST_IDS, map_log: int | None = None, head: int | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id, group_rows (rows with an equal set). broadcast, map_log and head set the bounds of what is
    broadcast, of the heavy map and of the counted hashes; by default the last two follow the number of shingles. None of them changes the result."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = materialise(texts.mapInArrow(tidy(_sizes), "id long, n long, ha long, hb long"), "sizes")
    keys = ["n", "ha", "hb"]
    classes = materialise(sized.where("n > 0 and id is not null").groupBy(*keys).agg(F.min("id").alias("node"), F.count("*").alias("copies")), "classes")
    totals = classes.agg(F.sum("n"), F.count("*")).first()
    if totals[1]:
        labels = _components(texts, sized, classes, int(totals[0]), int(totals[1]), broadcast, map_log or map_bits(totals[0]), head or head_bits(totals[0]))
        classes = classes.join(labels, "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
    else:
        classes = classes.withColumn("component_id", F.col("node"))
    classes = materialise(classes, "labelled-classes")
    alone = sized.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    held = sized.where("n > 0 and id is not null")
    grouped = join_counted(held, classes.select(*keys, "component_id", "copies"), keys, "copies", sized.count()).select("id", "n", "component_id", "copies")
    out = grouped.unionByName(alone)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("copies").alias("group_rows"))


def _components(texts: DataFrame, sized: DataFrame, classes: DataFrame, total: int, n_classes: int, broadcast: int, map_log: int, head: int) -> DataFrame:
    """(node, component_id) of the classes that have links."""
    spark = texts.sparkSession
    mean = total / n_classes
    limit = int(min(64, max(8, 1 + 2 * 0.68 * mean / PAIR_COST)))
    log_blocks = int(min(18, map_log - 3, max(3, np.ceil(np.log2(total / (1 << 20) + 1)))))
    nodes = classes.select(F.col("node").alias("id"))
    copies = materialise(sized.where("n = 0").select("id").unionByName(sized.where("n > 0 and id is not null").join(nodes, "id", "left_anti").select("id")).where("id is not null").distinct(), "copies")
    reps = _only(texts.where("id is not null"), copies, "left_anti", broadcast)
    if copies.count() > broadcast:
        reps = materialise(reps, "representatives")  # five scans read them, and the join has shuffled texts

    counted = reps.select("text").mapInArrow(tidy(_counted(log_blocks, head)), "block int, heads binary, counts binary")
    blocks = counted.groupBy("block").applyInArrow(_heavy(log_blocks, limit, head, map_log), "block int, bits binary, n1 long, n2 long").collect()
    width = 1 << (map_log - log_blocks - 3)
    bits = bytearray(1 << (map_log - 3))
    for r in blocks:
        bits[r.block * width : (r.block + 1) * width] = r.bits
    small = small_limit(sum(r.n1 for r in blocks), sum(r.n2 for r in blocks))
    bitmap = spark.sparkContext.broadcast(bytes(bits))

    found = materialise(reps.mapInArrow(tidy(_postings(bitmap, small, log_blocks)), _FOUND), "postings")
    pairs = found.where("kind = 'list'").select("block", "keys", "nodes", "sizes").groupBy("block").applyInArrow(_listed, "a long, b long, c long")
    pairs = _enough(pairs.groupBy("a", "b").agg(F.sum("c").alias("c")), found.where("kind = 'set'").select("node", F.col("key").alias("n"), F.col("block").alias("m")).dropDuplicates(["node"]))
    pairs = materialise(pairs, "pairs")
    sure = _small_links(found.where("kind = 'small'").select("key", "node", F.col("block").alias("side")))
    lists = _heavy_lists(reps, found.where("kind = 'heavy'").select("node").distinct(), bitmap, broadcast)

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(lists.select(F.col("node").alias("id"))).distinct()
    elements = _only(reps, materialise(ids, "candidates"), "left_semi", broadcast).mapInArrow(tidy(_arrays(bitmap)), "node long, light array<long>, heavy array<long>")
    elements = materialise(elements, "elements")

    # First every set meets its best partner only: groups of similar texts come together without their pairs.
    either = pairs.select("a", "b", "c").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    best = either.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("m"))).alias("x")).select("a", (-F.col("x.m")).alias("b"))
    hubs = lists.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("x"), F.count("*").alias("c")).select("key", (-F.col("x.m")).alias("hub"), "c")
    hubs = materialise(hubs, "hubs")
    spokes = join_counted(lists.drop("c"), hubs, ["key"], "c", lists.count()).where("node <> hub").groupBy("node", "hub").count()
    spokes = spokes.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("m"))).alias("x")).select(F.col("node").alias("a"), (-F.col("x.m")).alias("b"))
    spokes = materialise(_met(spokes, elements), "spokes")
    pairs_met = _met(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), elements)
    first = materialise(pairs_met.where(LINK).select("a", "b").unionByName(spokes.where(LINK).select("a", "b")).unionByName(sure), "links")
    labels = materialise(components(first), "components")

    # Then all candidates that are still apart. A set's distance is that of its heavy elements to those of its pivot.
    label = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c))
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component_id").alias(f"{c}_label"))
    apart = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where(label("a") != label("b")).select("a", "b")
    hub = spokes.select(F.col("b").alias("node")).distinct()
    away = spokes.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (F.col("h_a") + F.col("h_b") - 2 * F.col("ch")).alias("away"))
    away = away.join(hub, "node", "left_anti").unionByName(hub.select("node", F.col("node").alias("pivot"), F.lit(0).alias("away")))
    # Pivots of one candidate group can differ, so each group has a top member too, which all its sets are compared with.
    group = materialise(components(spokes.select("a", "b")), "groups").join(lists.select("node", "weight").distinct(), "node")
    top = group.groupBy("component_id").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("x")).select("component_id", (-F.col("x.m")).alias("b"))
    to_top = group.join(top, "component_id").select(F.col("node").alias("a"), "b")
    far = _met(to_top, elements).select(F.col("a").alias("node"), F.col("b").alias("top"), (F.col("h_a") + F.col("h_b") - 2 * F.col("ch")).alias("far"))
    far = materialise(far.distinct(), "far")
    placed = lists.select("key", "node", "n", "light").join(labels, "node", "left").withColumn("l", F.coalesce("component_id", "node"))
    mixed = placed.groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo < hi").select("key")
    placed = materialise(placed.join(mixed, "key", "left_semi").join(away, "node", "left").join(far, "node", "left"), "apart")
    # Where all sets of a part have one top member, linked ones differ in their distance to it by a ninth of both sizes at most, so rings of
    # that width meet their neighbours only, and a very large part is dealt over tasks. In other parts all sets meet.
    wide = placed.groupBy("key").agg(F.max("n").alias("most"), ((F.min("top") == F.max("top")) & (F.count("top") == F.count("*"))).alias("one_top"))
    ring = F.when(F.col("one_top"), F.floor(F.col("far") / F.ceil(2 * F.col("most") / 9))).otherwise(0)
    placed = materialise(placed.join(wide, "key").withColumn("ring", ring), "rings")
    cols = ("node", "n", "light", "l", "pivot", "away", "top", "far")
    x = placed.select("key", "ring", *[F.col(c).alias(f"{c}_a") for c in cols])
    y = placed.select("key", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"), *[F.col(c).alias(f"{c}_b") for c in cols])
    room = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) and 9 * (light_a + light_b + greatest(if(pivot_a = pivot_b, abs(away_a - away_b), 0), if(top_a = top_b, abs(far_a - far_b), 0))) <= n_a + n_b"
    across = x.join(y, ["key", "ring"]).where(f"node_a < node_b and l_a <> l_b and {room}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    rest = materialise(apart.unionByName(across).distinct(), "apart-pairs")
    if rest.isEmpty():
        return labels
    more = materialise(_met(rest, elements).where(LINK).select("a", "b"), "more-links")
    return labels if more.isEmpty() else components(more.unionByName(first))


def _enough(pairs: DataFrame, emitted: DataFrame) -> DataFrame:
    """pairs (a, b, c) with enough common prefix shingles c: what else two sets share comes after the m emitted ones of that set whose last one is the earlier."""
    side = lambda s: emitted.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"m_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("9 * (c + greatest(n_a - m_a, n_b - m_b)) >= 4 * (n_a + n_b)").select("a", "b", "c")


def _small_links(keys: DataFrame) -> DataFrame:
    """Links by equal subsets. Under one key either all sets are linked (equal sizes) or both sides are linked whole, so each set joins the first it is linked with."""
    first = [F.min(F.when(F.col("side") == i, F.col("node"))).alias(f"f{i}") for i in range(3)]
    firsts = materialise(keys.groupBy("key").agg(*first, F.count("*").alias("c")).where("c > 1"), "subsets")
    met = join_counted(keys, firsts, ["key"], "c", keys.count())
    met = met.select(F.col("node").alias("x"), F.when(F.col("side") == 0, F.col("f1")).when(F.col("side") == 1, F.col("f0")).otherwise(F.col("f2")).alias("y")).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _heavy_lists(reps: DataFrame, heavy: DataFrame, bitmap, broadcast: int) -> DataFrame:
    """(key, node, n, light, weight): the rarest budget + 1 parts of each of the heavy sets, where another set has the part too; weight: how much company a set has over all of these."""
    parts = _only(reps, materialise(heavy, "heavy"), "left_semi", broadcast).mapInArrow(tidy(_parts(bitmap)), "key long, node long, n long, light long, grp long, budget long")
    parts = materialise(parts, "parts")
    counts = materialise(parts.groupBy("key").agg(F.count("*").alias("c")), "part-counts")
    ranked = join_counted(parts, counts, ["key"], "c", parts.count()).withColumn("rank", F.row_number().over(Window.partitionBy("node", "grp").orderBy("c", "key")))
    lists = materialise(ranked.where("rank <= budget + 1 and c > 1").select("key", "node", "n", "light", "c"), "lists")
    weight = lists.groupBy("node").agg(F.sum("c").alias("weight"))
    return materialise(lists.join(weight, "node"), "weighted")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id, all columns kept; what has no component stays."""
    gone = join(docs, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone_id")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(gone, F.col(f"row.{id_col}") == F.col("gone_id"), "left_anti").select("row.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, greatest(len(ws) - 4, 1) + 1)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = s.doc_id"""
