"""Column batches of text as flat NumPy arrays, so that per-character work is vectorised."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose lengths sum to about ``most``; a longer row stands alone."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and each text's length."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, lengths


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each of the consecutive runs; an empty run sums to 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


_HELD: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives memory that the allocators keep back to the system, as far as they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that trims once its task's batches are done."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def use_memory(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Announces an operator that keeps tables between the tasks of a Python worker.

    Workers serve one operator after the other: what others have kept there is dropped by now.
    """
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
        trim()
    _HELD[name] = clear
