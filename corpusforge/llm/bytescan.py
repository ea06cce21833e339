"""Vectorised scans over Arrow string columns: words, rolling hashes, windows.

Everything works on the UTF-8 bytes that Arrow hands over, without a Python object for each word. A batch is cut into
slices of a few megabytes, so that memory doesn't grow with the batch; one text longer than a slice is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: its powers less 1 hold few factors of two
_MASK = (1 << 64) - 1
#: Space and the five controls from tab to carriage return part words.
SPACES = (32, 9, 10, 11, 12, 13)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); a permutation for each salt."""
    x = x ^ U64((salt * 0xD1B54A32D192ED03) & _MASK)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(seed: int, n: int = 256) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), seed)


BYTE_VALUES = (_table(11), _table(23))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest slice so far needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.empty(n, U64)
        out[0] = 1
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U64(pow(base, k, 1 << 64))
            k += m
        return out

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grow(_BASE, n), self._grow(pow(_BASE, -1, 1 << 64), n)
        return self.up, self.down


POWERS = _Powers()


class Rolling:
    """Prefix sums of a polynomial over the ring of 64-bit integers; of() hashes any [start, end) in one step."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        up, self.down = POWERS.get(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(U64))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of a string or binary column; null is empty."""
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and one after) the number of words before it."""
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: int = 0) -> np.ndarray:
    return Rolling(BYTE_VALUES[table][data]).of(start, end)


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of `size` items that stay within a row, and the row of each; counts: items before each row."""
    n = np.maximum(np.diff(counts) - size + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + counts[:-1][row], row


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The integers of the ranges [start, start + n), one after the other."""
    n = np.maximum(n, 0)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def covered(start: np.ndarray, size: int, n: int) -> np.ndarray:
    """A mask of length n: true where a window [s, s + size) lies."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + size, n), -1)
    return np.cumsum(step)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def winnow(hashes: np.ndarray, size: int) -> np.ndarray:
    """Positions of winnowed anchors: one that has the least hash of each run of `size`; any such run holds one.

    The least hash depends on the run's own hashes alone, so equal runs yield an anchor of equal hash wherever they
    stand; of tied places the rightmost is taken, which may differ between copies and doesn't matter to their hash.
    """
    n, bits = len(hashes), 22
    if n == 0:
        return np.zeros(0, np.int64)
    low = U64((1 << bits) - 1)
    value = (hashes & ~low) | ((-np.arange(n, dtype=np.int64)).astype(U64) & low)
    if n <= size:
        return np.array([int(np.argmin(value))])
    width = 1
    while width * 2 <= size:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    m = n - size + 1
    value = np.minimum(value[:m], value[size - width : size - width + m])
    begin = np.arange(m, dtype=np.int64)
    found = begin + ((-(value & low).astype(np.int64) - begin) & int(low))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
