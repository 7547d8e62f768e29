"""Counting and chaining k-mers by minimizers: neighbours in a sequence mostly share one, so they travel and are joined together.

The minimizer of a k-mer is the least hash of its m-mers (of an m-mer and its reverse complement the smaller one in canonical graphs). A super-k-mer is
a run of k-mers with one minimizer; as 2-bit bases it costs a byte or so a k-mer. A task holds the super-k-mers of its minimizers packed and sums
up their k-mers in passes, so what it needs beside them follows a block. Joints of a minimizer that very many have are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators.ids import ordered_ids
from strandloom.session import materialise, ship

#: Bases of a limb, and of the longest k-mer of two limbs.
LIMB, WIDEST = 32, 63
PIECE = 1 << 20
#: k-mers, or joints, that a task works on at a time.
BLOCK = 1 << 20
#: Joints of a minimizer with at least this share of all are dealt out.
HOT_SHARE = 0.001
NONE = 255
_CODES = np.full(256, NONE, np.uint8)
for _i, _b in enumerate(S.BASES):
    _CODES[ord(_b)] = _i


def width(k: int) -> int:
    """Bases of a minimizer."""
    return max(1, min(11, k - 1, (k + 1) // 2))


def runs_of(codes: np.ndarray, size: int) -> np.ndarray:
    """Every run of `size` (at most 32) codes as a number of 2 bits a code, by joining runs of powers of two."""
    out, have, part, step = None, 0, codes.astype(np.uint64), 1
    while step <= size:
        if size & step:
            out = part if out is None else (out[: len(part) - have] << np.uint64(2 * step)) | part[have : have + len(out)]
            have += step
        if 2 * step <= size:
            part = (part[:-step] << np.uint64(2 * step)) | part[step:]
        step *= 2
    return out[: len(codes) - size + 1]


def limbs(codes: np.ndarray, k: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of every k-mer, or of its reverse complement; hi is 0 up to 32 bases."""
    if back:
        codes = (codes ^ 2)[::-1]
    if k <= LIMB:
        lo = runs_of(codes, k)
        hi = np.zeros(len(lo), np.uint64)
    else:
        n = len(codes) - k + 1
        hi, lo = runs_of(codes, k - LIMB)[:n], runs_of(codes, LIMB)[k - LIMB :]
    return (hi[::-1], lo[::-1]) if back else (hi, lo)


def minimizers(codes: np.ndarray, k: int, m: int, canonical: bool) -> np.ndarray:
    """The minimizer of every k-mer."""
    x = runs_of(codes, m)
    if canonical:
        x = np.minimum(x, runs_of((codes ^ 2)[::-1], m)[::-1])
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        x = ~(x ^ (x >> np.uint64(29)))  # As alone, which are frequent, come last
    n, step = k - m + 1, 1
    while 2 * step <= n:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    return (np.minimum(x[: len(x) - (n - step)], x[n - step :]) >> np.uint64(1)).astype(np.int64)


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., sizes[0] of them, then those of starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def left_limbs(octets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32 bases and the next 32 from base `at` of packed ones on, whatever follows the end."""
    byte, shift = at // 4, (at % 4 * 2).astype(np.uint64)
    octets = np.concatenate((octets, np.zeros(24, np.uint8)))
    eight = np.ndarray((len(octets) - 7,), ">u8", octets, 0, (1,))
    x, y = eight[byte].astype(np.uint64), eight[byte + 8].astype(np.uint64)
    return x << shift | y >> np.uint64(1) >> (np.uint64(63) - shift), y << shift | octets[byte + 16].astype(np.uint64) >> (np.uint64(8) - shift)


def _other_strand(x: np.ndarray) -> np.ndarray:
    """Complements of 32 bases in the other order."""
    for bits in (2, 4, 8, 16):
        mask = np.uint64(sum(((1 << bits) - 1) << at for at in range(0, 64, 2 * bits)))
        x = x >> np.uint64(bits) & mask | (x & mask) << np.uint64(bits)
    return (x >> np.uint64(32) | x << np.uint64(32)) ^ np.uint64(0xAAAAAAAAAAAAAAAA)


def _strands(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Reverse complements of k-mers as (hi, lo)."""
    if k <= LIMB:
        return hi, _other_strand(lo) >> np.uint64(64 - 2 * k)
    first, second, spare = _other_strand(lo), _other_strand(hi), np.uint64(128 - 2 * k)
    return first >> spare, first << (np.uint64(64) - spare) | second >> spare


def _letters(hi: np.ndarray, lo: np.ndarray, k: int) -> pa.Array:
    """The k-mers as strings."""
    out = np.empty((len(lo), k), np.uint8)
    for i in range(k):
        at = k - 1 - i
        out[:, i] = (lo >> np.uint64(2 * at) if at < LIMB else hi >> np.uint64(2 * (at - LIMB))) & np.uint64(3)
    letters = np.frombuffer(S.BASES.encode(), np.uint8)[out]
    return pa.Array.from_buffers(pa.string(), len(lo), [None, pa.py_buffer(np.arange(0, k * len(lo) + 1, k, dtype=np.int32)), pa.py_buffer(letters)])


def _lexical(x: np.ndarray) -> np.ndarray:
    """Codes in alphabetical order: T and G change places."""
    return x ^ (x >> np.uint64(1) & np.uint64(0x5555555555555555))


def _planes(x: np.ndarray) -> bytes:
    """8-byte numbers byte by byte: all first bytes, all second bytes, ..., so that compression packs away what is alike in them."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: Iterable[bytes]) -> np.ndarray:
    parts = [np.frombuffer(b, np.uint8).reshape(8, -1).T.ravel().view(np.int64) for b in data]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def super_kmers(seqs: DataFrame, k: int, canonical: bool, parts: int) -> DataFrame:
    """(part, at, places, bases) of (rank, pos, seq), or of (seq): arrays of super-k-mers, one row a block and part, the same part for one minimizer.

    at: rank and position in one number, as _planes, empty without ranks; places: 64 times the first base's place in its byte and one less than the
    number of k-mers, a byte each; bases: packed, each from a byte of its own on.
    """
    ship(seqs.sparkSession)
    m, ranked = width(k), "rank" in seqs.columns

    def of(ranks: np.ndarray | None, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        # Texts are joined with a sign that is no base between them.
        sizes = np.diff(offsets)
        codes = np.full(int(sizes.sum()) + len(sizes) + k, NONE, np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        codes[_gathered(first, sizes)] = _CODES[data[offsets[0] : offsets[-1]]]
        bad = np.concatenate(([0], np.cumsum(codes == NONE, dtype=np.int32)))
        valid = bad[k:] == bad[:-k]
        codes &= 3
        mini = minimizers(codes, k, m, canonical)
        new = np.ones(len(valid), bool)
        new[1:] = (mini[1:] != mini[:-1]) | ~valid[:-1]
        start = np.flatnonzero(new & valid)
        n = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1 - start
        pieces = (n + 63) // 64
        at = _gathered(np.zeros(len(n), np.int64), pieces)
        start, n = np.repeat(start, pieces) + 64 * at, np.minimum(64, np.repeat(n, pieces) - 64 * at)
        part = mini[start] % parts
        order = np.argsort(part, kind="stable")
        start, n, part = start[order], n[order], part[order]
        padded = np.concatenate((codes, np.zeros(-len(codes) % 4, np.uint8))).reshape(-1, 4)
        packed = padded[:, 0] << 6 | padded[:, 1] << 4 | padded[:, 2] << 2 | padded[:, 3]
        octets = (start + n + k - 1 + 3) // 4 - start // 4
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        each = np.diff(np.append(head, len(part)))
        row = np.searchsorted(first, start, "right") - 1
        place = ranks[row] + (start - first[row]) if ranked else start
        at = pa.array([_planes(place[i : i + n_]) if ranked else b"" for i, n_ in zip(head.tolist(), each.tolist(), strict=True)], pa.binary())
        columns = [((start % 4 << 6 | n - 1).astype(np.uint8), each), (packed[_gathered(start // 4, octets)], np.add.reduceat(octets, head) if len(head) else each)]
        return pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), at, *[_binary(np.ascontiguousarray(c), size) for c, size in columns]], names=["part", "at", "places", "bases"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = b.column("rank").to_numpy() * (1 << 31) + b.column("pos").to_numpy() if ranked else None
            column = b.column("seq")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 2 * PIECE, "right")) - 1)
                yield of(ranks[i:j] if ranked else None, offsets[i : j + 1], data)
                i = j

    return seqs.select(*(["rank", "pos"] if ranked else []), F.col("seq").cast("binary").alias("seq")).mapInArrow(run, "part int, at binary, places binary, bases binary")


def _counted(rows: list[tuple], k: int, canonical: bool, lexical: bool) -> tuple[np.ndarray, ...]:
    """(hi, lo, first, n) of the k-mers of super-k-mers, one each; first is the place, doubled, and 1 more where the k-mer stands there as its reverse complement; 0 without places."""
    at, (places, octets) = _numbers(r[0] for r in rows), (np.frombuffer(b"".join(r[i] for r in rows), np.uint8) for i in (1, 2))
    skip, n = (places >> 6).astype(np.int64), (places & 63).astype(np.int64) + 1
    size = (skip + n + k - 1 + 3) // 4
    a, b = left_limbs(octets, _gathered(4 * (np.cumsum(size) - size) + skip, n))
    if k <= LIMB:
        hi, lo = np.zeros(len(a), np.uint64), a >> np.uint64(64 - 2 * k)
    else:
        bits = np.uint64(2 * (k - LIMB))
        hi, lo = a >> (np.uint64(64) - bits), a << bits | b >> (np.uint64(64) - bits)
    first = 2 * _gathered(at, n) if len(at) else np.zeros(len(hi), np.int64)
    if canonical:
        bhi, blo = _strands(hi, lo, k)
        (x, y), (u, v) = ((_lexical(p), _lexical(q)) if lexical else (p, q) for p, q in ((hi, lo), (bhi, blo)))
        less = (u < x) | (u == x) & (v < y)
        hi, lo = np.where(less, bhi, hi), np.where(less, blo, lo)
        first = first + less if len(at) else first
    return hi, lo, first, np.ones(len(hi), np.int64)


def _summed(parts: list[tuple[np.ndarray, ...]], k: int, placed: bool) -> tuple[np.ndarray, ...]:
    """(hi, lo, first, n), a row for each k-mer: the least first, all n."""
    hi, lo, first, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    if k <= LIMB and not placed and len(parts) == 1:
        lo = np.sort(lo)
        new = np.flatnonzero(np.concatenate(([True], lo[1:] != lo[:-1])))
        return hi[new], lo[new], first[new], np.diff(np.append(new, len(lo)))
    order = np.argsort(lo)
    x = lo[order]
    same = x[1:] == x[:-1]
    if k > LIMB and np.any(same & (hi[order][1:] != hi[order][:-1])):
        tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        group, own = np.cumsum(np.concatenate(([True], ~same)))[tied], order[tied]
        order[tied] = own[np.lexsort((hi[own], group))]
    hi, lo = hi[order], lo[order]
    new = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    return hi[new], lo[new], np.minimum.reduceat(first[order], new), np.add.reduceat(n[order], new)


def _met(dealt: DataFrame, k: int, canonical: bool, put: Callable[..., pa.RecordBatch], schema: str, lexical: bool = False, placed: bool = True) -> DataFrame:
    """put(hi, lo, first, n) of all k-mers. A task holds its super-k-mers packed, and sums up those of one pass at a time."""
    block = BLOCK

    def blocks(held: list[tuple]) -> Iterator[list[tuple]]:
        some, size = [], 0
        for r in held:
            some.append(r)
            size += int((np.frombuffer(r[1], np.uint8) & 63).sum(dtype=np.int64)) + len(r[1])
            if size >= block:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("at", "places", "bases")], strict=True)]
        every = list(blocks(held))
        passes = -(-len(every) // 2)
        for turn in range(passes):
            sums, waiting = [], 0
            for rows in every:
                x = _counted(rows, k, canonical, lexical)
                if passes > 1:
                    with np.errstate(over="ignore"):
                        mixed = (x[1] ^ x[0] << np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    own = np.flatnonzero(mixed % np.uint64(passes) == turn)
                    x = tuple(c[own] for c in x)
                sums.append(x)
                waiting += len(x[0])
                if waiting > block and len(sums) > 1:
                    sums, waiting = [_summed(sums, k, placed)], 0
            if len(sums) > 1 or waiting:
                sums = [_summed(sums, k, placed)]
            hi, lo, first, n = sums[0]
            for i in range(0, len(hi), 1 << 16):
                yield put(*(c[i : i + (1 << 16)] for c in (hi, lo, first, n)))

    return dealt.select("at", "places", "bases").mapInArrow(run, schema)


def _ranked(seqs: DataFrame, order: list[str], k: int, canonical: bool) -> DataFrame:
    """super_kmers of sequences by their rank in `order`, dealt."""
    ranked = ordered_ids(seqs.select(*order, "seq"), order, "rank").where(F.length("seq") >= k)
    rank = F.when(F.col("rank") < 1 << 31, F.col("rank")).otherwise(F.raise_error(F.lit("more than 2^31 records")).cast("long")).alias("rank")
    return _dealt(ranked.select(rank, "seq"), k, canonical)


def _dealt(seqs: DataFrame, k: int, canonical: bool) -> DataFrame:
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in seqs.columns if c != "seq"]
    cut = F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(PIECE))).alias("pos")
    rows = seqs.where(F.length("seq") >= k).select(*keep, F.col("seq").cast("binary").alias("seq"), cut).select(*keep, "pos", F.substring("seq", F.col("pos") + 1, F.lit(PIECE + k - 1)).alias("seq"))
    return super_kmers(rows, k, canonical, 8 * n).repartition(4 * n, "part")


def counts(seqs: DataFrame, order: list[str], k: int, canonical: bool) -> DataFrame:
    """(hi, lo, first, n) of all k-mers without N: their limbs, occurrences, and `first` as in _counted, ascending by `order` and position."""
    names = ["hi", "lo", "first", "n"]
    put = lambda hi, lo, first, n: pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(first), pa.array(n)], names=names)
    return _met(_ranked(seqs, order, k, canonical), k, canonical, put, "hi long, lo long, first long, n long")


def totals(seqs: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(kmer, n) of all k-mers without N, or of the smaller of each and its reverse complement. Neither order nor places are needed, so nothing is written but one shuffle of super-k-mers."""
    put = lambda hi, lo, first, n: pa.RecordBatch.from_arrays([_letters(hi, lo, k), pa.array(n)], names=["kmer", "n"])
    return _met(_dealt(seqs.select("seq"), k, canonical), k, canonical, put, "kmer string, n long", True, False)


def nodes(seqs: DataFrame, order: list[str], k: int, canonical: bool, multiplicity: int = 1) -> DataFrame:
    """(first, seq) of all k-mers that occur so often, in the orientation seen first."""

    def put(hi, lo, first, n):
        own = np.flatnonzero(n >= multiplicity)
        hi, lo, first = hi[own], lo[own], first[own]
        back = np.flatnonzero(first & 1)
        hi[back], lo[back] = _strands(hi[back], lo[back], k)
        return pa.RecordBatch.from_arrays([pa.array(first), _letters(hi, lo, k)], names=["first", "seq"])

    return _met(_ranked(seqs, order, k, canonical), k, canonical, put, "first long, seq string")


def joints(nodes: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(src, dst) of oriented nodes (nid, seq): the only one that ends with some k - 1 bases, and the only one that begins with them. Partitions are by minimizers."""
    ship(nodes.sparkSession)
    j = k - 1
    m = width(j)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nid = b.column("nid").to_numpy()
            text = np.frombuffer("".join(x for c in ("left", "right") for x in b.column(c).to_pylist()).encode(), np.uint8)
            codes = _CODES[text]
            hi, lo = (x[::j] for x in limbs(codes, j))
            mini = minimizers(codes, j, m, canonical)[::j]
            out = np.repeat([False, True], len(nid))
            yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(hi.astype(np.int64)), pa.array(lo.view(np.int64) if lo.flags.c_contiguous else np.ascontiguousarray(lo).view(np.int64)), pa.array(np.concatenate((nid, nid))), pa.array(out)], names=["mini", "hi", "lo", "nid", "out"])

    ends = nodes.select("nid", F.left("seq", F.lit(j)).alias("left"), F.right("seq", F.lit(j)).alias("right")).mapInArrow(run, "mini long, hi long, lo long, nid long, out boolean")
    ends = materialise(ends, "ends")
    per = ends.groupBy("mini").agg(F.count("*").alias("c"))
    hot = per.where(F.col("c") >= max(1000, int(ends.count() * HOT_SHARE))).select("mini", F.lit(True).alias("hot"))
    bucket = F.when(F.col("hot"), F.xxhash64("hi", "lo")).otherwise(F.col("mini"))
    rows = ends.join(F.broadcast(hot), "mini", "left").select(bucket.alias("bucket"), "hi", "lo", "nid", "out")
    rows = rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    src, dst = F.when(F.col("out"), F.col("nid")), F.when(~F.col("out"), F.col("nid"))
    met = rows.groupBy("bucket", "hi", "lo").agg(F.max(src).alias("src"), F.max(dst).alias("dst"), F.count(src).alias("o"), F.count(dst).alias("i"))
    met = met.where("o = 1 and i = 1 and src <> dst").select("src", "dst")
    return met.where(F.col("dst") != F.col("src").bitwiseXOR(1)) if canonical else met


def contracted(joined: DataFrame) -> DataFrame:
    """(start, nid, off, last) of joints: the paths that the joints of a task's blocks form, as steps from their first node; last marks their ends. A cycle starts and ends at its least node."""
    ship(joined.sparkSession)

    def of(src: list[int], dst: list[int]) -> pa.RecordBatch:
        after = dict(zip(src, dst, strict=True))
        starts = [*(after.keys() - set(dst)), *sorted(src)]  # cycles are what is left after the paths
        rows: list[tuple] = []
        for start in starts:
            nid, off = after.pop(start, None), 1
            while nid is not None:
                follows = after.pop(nid, None)
                rows.append((start, nid, off, follows is None))
                nid, off = follows, off + 1
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["start", "nid", "off", "last"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for b in batches:
            src += b.column("src").to_pylist()
            dst += b.column("dst").to_pylist()
            if len(src) >= BLOCK:
                yield of(src, dst)
                src, dst = [], []
        if src:
            yield of(src, dst)

    return joined.mapInArrow(run, "start long, nid long, off long, last boolean")
