"""Vectorised word tables over Arrow string columns: which row a word is in, its bytes, and a 64-bit hash.

Work is done on blocks of about a quarter of a megabyte (some 60 bytes of arrays a byte of text), so memory stays bounded by the block (and the arrays of
one text's words), however large an Arrow batch or a single text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ROOT) | np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _ROOT))), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _INVERSE))), dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass(frozen=True)
class WordKind:
    """Which bytes belong to words; A-Z count as a-z."""

    inside: np.ndarray
    fold: np.ndarray

    @staticmethod
    def of(inside) -> WordKind:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        return WordKind(np.array([bool(inside(b)) for b in range(256)]), fold)


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = WordKind.of(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: [^\x20\x09-\x0D]+
NONSPACE = WordKind.of(lambda b: not (b == 32 or 9 <= b <= 13))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _hashed(data: np.ndarray, lo: int, hi: int, breaks: np.ndarray, kind: WordKind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (absolute) and hashes of the words in data[lo:hi]; a word also ends at each of breaks."""
    part = data[lo:hi]
    inside = kind.inside[part]
    before = np.empty_like(inside)
    if len(part):
        before[0] = False
        before[1:] = inside[:-1]
    before[breaks - lo] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(part):
        after[-1] = False
        after[:-1] = inside[1:]
    cut = breaks[breaks > lo] - lo - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power(len(part) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((kind.fold[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return starts + lo, ends + lo, hashes


def word_blocks(data: np.ndarray, off: np.ndarray, kind: WordKind) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each word, starts, ends, hashes), for runs of whole rows of about BLOCK bytes."""
    n, row = len(off) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK, "right")) - 1)
        lo, hi = int(off[row]), int(off[last])
        if hi - lo <= BLOCK or last > row + 1:
            breaks = np.unique(off[row:last])
            parts = [_hashed(data, lo, hi, breaks[breaks < hi], kind)]
        else:  # one long text: blocks that end between words
            parts, at = [], lo
            while at < hi:
                end = min(at + BLOCK, hi)
                if end < hi:
                    gap = np.flatnonzero(~kind.inside[data[at:end]])
                    if len(gap):
                        end = at + int(gap[-1]) + 1
                    else:
                        gap = np.flatnonzero(~kind.inside[data[end:hi]])
                        end = end + int(gap[0]) if len(gap) else hi
                parts.append(_hashed(data, at, end, np.array([at]), kind))
                at = end
        s, e, h = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        yield row, last, np.searchsorted(off, s, "right") - 1, s, e, h
        row = last


def windows(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of size words that lies in one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j, m in enumerate(multipliers(size)):
            total += hashes[j : j + n] * m
        total = mix(total + np.uint64(size))
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return first, total[first]
