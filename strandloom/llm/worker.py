"""What Python workers hold between tasks. Spark gives a worker's next task to any operator, so what one leaves there counts against the others."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_remembered: dict = {}


def remembered(key, make: Callable):
    """make(), kept by this worker for its next tasks until a tidy one of another operator runs in it."""
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool and, with glibc, the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable, keep: bool = False) -> Callable:
    """run, a function over batches, which first drops what is remembered (unless keep) and gives its memory back when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        if not keep:
            _remembered.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
