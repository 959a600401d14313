"""Words of many texts at once: numpy over the UTF-8 buffers of Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; one longer text is worked on alone.
SLICE_BYTES = 1 << 18


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts."""
    raw, offs = buffers(column)
    rows, lo = len(offs) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, rows)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for the bytes that end a word: space and 9 to 13."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def alnum_table() -> np.ndarray:
    """True for the bytes that end a word made of digits, a to z and bytes from 128 up."""
    table = np.ones(256, bool)
    table[48:58] = table[97:123] = table[128:] = False
    return table


def spans(raw: np.ndarray, offs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word; ``ends`` tells which bytes part words."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~ends[raw]
    step = np.diff(inside)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    if len(cuts):
        cuts = np.unique(cuts)
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a text ends inside a run
        if len(cuts):
            start, stop = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((stop, cuts)))
    return start, stop, np.searchsorted(offs, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = (seed * 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF
    base ^= 2 if base % 4 == 1 else 0
    forth, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    np.multiply.accumulate(forth, out=forth)
    np.multiply.accumulate(back, out=back)
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed * 2 + 1)), forth, back


#: Powers of a seed that a worker keeps, in two sizes; those of longer inputs are made anew each time.
_held = lru_cache(8)(_powers)
_SIZES = 1 << 16, 2 * SLICE_BYTES
#: What empties the caches of operators, by name: a worker that turns to another operator drops them.
caches = {}


def run_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of values[start:stop] of each run. Bytes go through a table first."""
    size = next((n for n in _SIZES if len(values) < n), len(values) + 1)
    table, forth, back = (_held if size <= _SIZES[-1] else _powers)(seed, size)
    own = table[values] if values.dtype == np.uint8 else mix(values + np.uint64(seed))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(own * forth[: len(values)], out=total[1:])
    return mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def released(run, keep: str = ""):
    """``run``, a function from batches to batches, giving memory back at its end: the next stage shares the worker.

    Caches but the one named ``keep`` go first.
    """

    def whole(batches):
        for name, empty in caches.items():
            if name != keep:
                empty()
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def characters(raw: np.ndarray) -> np.ndarray | None:
    """Characters before each byte position, or None if all bytes are ASCII."""
    if not len(raw) or raw.max() < 128:
        return None
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return before
