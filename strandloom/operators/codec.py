"""Encodings as bytes: one blob a walk, or a piece of one, in the sizes that encode.encoded_bytes counts.

A blob is the number of its patches and the patches. A patch is up to 64 extensions of one kind behind a byte with the kind in the low two
bits and their number less one in the others. Targets are numbers of 7 bits a byte, the ninth byte with 8; bases are four a byte, the first in
the low bits; a repetition is its run as a number and its offset as a byte. Numbers are one byte up to 250, else a mark and 2, 4 or 8 bytes, the low one first.
What isn't part of the encoding (the nodes of NN and R rows, the steps of all but the first row) isn't in the blob.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.encode import EXT, KEY, PIECE
from strandloom.operators.groups import map_groups

KINDS = ["TN", "NN", "R"]
PATCH = 64
#: Marks of numbers over 250 and the bytes that follow.
MARKS = {251: 2, 252: 4, 253: 8}
BLOB = "seq_id string, contig_idx int, piece long, start long, extensions long, blob binary, crc long"


def _number(x: int) -> bytes:
    if x < 251:
        return bytes([x])
    mark = next(m for m, n in MARKS.items() if x < 1 << (8 * n))
    return bytes([mark]) + x.to_bytes(MARKS[mark], "little")


def _node(x: int) -> bytes:
    out = bytearray()
    while x >= 128 and len(out) < 8:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def pack(kinds: list[str], nids: list[int | None], bases: list[int | None], runs: list[int | None], offs: list[int | None]) -> bytes:
    """The blob of a walk's extensions."""
    patches, i = [], 0
    while i < len(kinds):
        kind, j = kinds[i], i + 1
        while j < len(kinds) and j - i < PATCH and kinds[j] == kind:
            j += 1
        head = bytes([KINDS.index(kind) | (j - i - 1) << 2])
        if kind == "TN":
            body = b"".join(map(_node, nids[i:j]))
        elif kind == "NN":
            codes = np.zeros(-(-(j - i) // 4) * 4, np.uint8)
            codes[: j - i] = bases[i:j]
            body = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()
        else:
            body = b"".join(_number(r) + bytes([o]) for r, o in zip(runs[i:j], offs[i:j], strict=True))
        patches.append(head + body)
        i = j
    return _number(len(patches)) + b"".join(patches)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the blob ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        x = self.take(1)[0]
        if x > 253:
            raise ValueError(f"no number begins with {x}")
        return int.from_bytes(self.take(MARKS[x]), "little") if x in MARKS else x

    def node(self) -> int:
        out = 0
        for i in range(9):
            x = self.take(1)[0]
            if i == 8:
                return out | x << 56
            out |= (x & 127) << (7 * i)
            if x < 128:
                return out
        raise AssertionError


def unpack(data: bytes) -> list[tuple[str, int | None, int | None, int, int | None]]:
    """(kind, nid, base, nb, off) of a blob; nb is 1 but for repetitions. A blob that is cut, longer than its patches or has an unknown kind raises."""
    r, out = _Reader(data), []
    for _ in range(r.number()):
        head = r.take(1)[0]
        if head & 3 > 2:
            raise ValueError("unknown kind of extension")
        kind, n = KINDS[head & 3], (head >> 2) + 1
        if kind == "TN":
            out += [(kind, r.node(), None, 1, None) for _ in range(n)]
        elif kind == "NN":
            codes = np.frombuffer(r.take(-(-n // 4)), np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
            out += [(kind, None, int(c), 1, None) for c in codes.ravel()[:n]]
        else:
            out += [(kind, None, None, r.number(), r.take(1)[0]) for _ in range(n)]
    if r.at != len(data):
        raise ValueError("the blob goes on after its patches")
    return out


def to_bytes(extensions: DataFrame) -> DataFrame:
    """BLOB rows of extension rows: a walk's pieces are blobs of their own."""

    def of(key: tuple, c: dict[str, list]) -> Iterable[tuple]:
        blob = pack(c["kind"], c["nid"], c["base"], c["nb"], c["off"])
        yield (*key, c["at"][0], len(c["kind"]), blob, zlib.crc32(blob))

    rows = extensions.select(*KEY, F.floor(F.col("ext_idx") / PIECE).alias("piece"), "ext_idx", "kind", "nid", "base", "nb", "off", "at")
    return map_groups(rows, [*KEY, "piece"], "ext_idx", of, BLOB)


def from_bytes(blobs: DataFrame) -> DataFrame:
    """The extension rows of BLOB rows, for encode.decode. Raises where a blob isn't what its checksum says."""

    def of(key: tuple, c: dict[str, list]) -> Iterable[tuple]:
        for piece, start, n, blob, crc in zip(*[c[x] for x in ("piece", "start", "extensions", "blob", "crc")], strict=True):
            if zlib.crc32(blob) != crc:
                raise ValueError("the checksum of a blob is wrong")
            found = unpack(blob)
            if len(found) != n:
                raise ValueError("a blob has another number of extensions")
            for i, x in enumerate(found):
                yield (*key, piece * PIECE + i, *x, start if i == 0 else None)

    return map_groups(blobs, KEY, "piece", of, EXT)
