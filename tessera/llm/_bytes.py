"""Texts of an Arrow batch as one run of UTF-8 bytes, and the words in it.

Everything here works on whole columns with numpy, so that the cost of a text is
that of a few passes over its bytes, however many words it has.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The six white-space bytes of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


_models: list = []


def one_model(load: Callable) -> Callable:
    """Caches what ``load`` returns, for as long as the process uses no other such model: a worker serves many stages."""
    cached = functools.cache(load)
    _models.append(cached)

    @functools.wraps(load)
    def get(*args):
        for other in _models:
            if other is not cached and other.cache_info().currsize:
                other.cache_clear()
        return cached(*args)

    return get


def release() -> None:
    """Gives freed memory back to the system where the C library can, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and each row's offset among them (one more than rows); null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and the index of each row's first word (one more than rows)."""
    n = len(data)
    inside = ~SPACE[data]
    border = np.zeros(n + 1, bool)
    border[off] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The named spans one behind the other, ``gap`` blanks after each, and where each begins."""
    at = np.concatenate(([0], np.cumsum(lengths + gap)))
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(starts)), lengths)
    inner = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[at[:-1][owner] + inner] = data[starts[owner] + inner]
    return out, at
