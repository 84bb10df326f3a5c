"""Texts as flat arrays: an Arrow string column is one byte buffer with offsets, so that words, lines and their hashes
come from a few numpy passes over the bytes, with no Python object for a word.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes, ASCII letters lowered ("fold" tables), or a maximal
run of anything but ASCII white space ("raw" tables).
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = U(0xD6E8FEB86659FD93)
GRAM = U(0xA0761D6478BD642F)
SLICE = 1 << 20

_byte = np.arange(256)
LETTER = (_byte >= 128) | ((_byte >= 48) & (_byte < 58)) | ((_byte >= 65) & (_byte < 91)) | ((_byte >= 97) & (_byte < 123))
DARK = ~np.isin(_byte, [9, 10, 11, 12, 13, 32])
LOWER = np.where((_byte >= 65) & (_byte < 91), _byte + 32, _byte).astype(np.uint8)
SAME = _byte.astype(np.uint8)

_powers = [np.ones(1, U), np.ones(1, U)]


def give_back() -> None:
    """Hands freed memory back to the system, which a worker would otherwise keep to itself while it waits."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function of Arrow batches or of tables, which hands memory back when it is through."""

    def of_batches(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    def of_table(table):
        try:
            return run(table)
        finally:
            give_back()

    def of_two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return of_batches if inspect.isgeneratorfunction(run) else of_table if len(inspect.signature(run).parameters) == 1 else of_two


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # not the GNU library
    _libc = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE)
        for k, base in enumerate((BASE, INVERSE)):
            table = np.full(size, base, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX
    h = (h ^ (h >> U(32))) * MIX
    return h ^ (h >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if big else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(offs)[~valid] > 0).any():
            return buffers(column.fill_null("" if not pa.types.is_binary(column.type) else b""))
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows of about `most` bytes; a longer text is alone."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words): bytes of each word, and the number of words before each row."""
    keep = table[data]
    first, last = keep.copy(), keep.copy()
    if len(data):
        at = offs[(offs > 0) & (offs < len(data))]
        before, after = keep[:-1].copy(), keep[1:].copy()
        before[at - 1] = False
        after[at - 1] = False
        first[1:] &= ~before
        last[:-1] &= ~after
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each span of the bytes."""
    if len(data) <= 2 * SLICE:
        return mix(_raw(data, starts, ends, fold) + (ends - starts).astype(U))
    # by parts, so that the tables of powers stay small
    out = np.empty(len(starts), U)
    long = ends - starts > SLICE
    for i in np.flatnonzero(long).tolist():
        out[i] = _long(data[starts[i] : ends[i]], fold)
    order = np.flatnonzero(~long)
    order = order[np.argsort(starts[order], kind="stable")]
    begin = starts[order]
    i = 0
    while i < len(order):
        j = int(np.searchsorted(begin, begin[i] + SLICE, "left"))
        own, base = order[i:j], begin[i]
        out[own] = _raw(data[base : base + 2 * SLICE], starts[own] - base, ends[own] - base, fold)
        i = j
    return mix(out + (ends - starts).astype(U))


def _raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((fold[data].astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _long(data: np.ndarray, fold: np.ndarray) -> int:
    total, mask = 0, (1 << 64) - 1
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        total += int(_raw(part, np.array([0]), np.array([len(part)]), fold)[0]) * pow(int(BASE), a, 1 << 64)
    return total & mask


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, without regard to rows; the last n - 1 places are left out."""
    if len(words) < n:
        return np.zeros(0, U)
    out = np.zeros(len(words) - n + 1, U)
    for i in range(n):
        out = out * GRAM + words[i : len(words) - n + 1 + i]
    return mix(out)


def inside(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the n-grams that lie within one row; bounds: words before each row."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    return np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + bounds[rows], rows


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all runs, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given spans, one after another."""
    return data[runs(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])


def strings(data: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow column of the bytes between the offsets."""
    kind = kind or pa.string()
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        offs = offs.astype(np.int32)
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(np.ascontiguousarray(data))])
