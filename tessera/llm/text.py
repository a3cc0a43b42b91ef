"""Vectorised word and window hashing over Arrow string columns.

Used inside ``mapInArrow`` tasks.  A batch is cut into chunks of bounded text
size, so the temporary arrays stay small whatever the batch size; one document
longer than the bound makes a chunk of its own.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words in ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

CHUNK_BYTES = 3 << 20

_rng = np.random.default_rng(20240229)
_BYTE_AT = _rng.integers(0, 2**64, size=64 * 256, dtype=np.uint64)
#: Odd multipliers of the two window polynomials.
_Q = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, *columns: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``columns`` hold about ``limit`` bytes at most."""
    if not batch.num_rows:
        return
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    which = (np.cumsum(size) - size) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a column: byte spans, 64-bit hashes, and ``first``, each row's first word."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE):
        self.data, self.offsets = raw(column)
        inside = ~separators[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        opens[edges] = inside[edges]
        ends = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        closes[ends] = inside[ends]
        self.start, self.stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self._inside = inside

    def row(self) -> np.ndarray:
        """Each word's row."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        length = self.stop - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        before = np.cumsum(length) - length
        at = np.arange(length.sum(), dtype=np.int64) - np.repeat(before, length)
        value = _BYTE_AT[((at & 63) << 8) | self.data[self._inside]]
        if length.max() > 64:
            value = value * ((at >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return mix(np.add.reduceat(value, before) ^ length.astype(np.uint64))


def windows(words: Words, hashes: np.ndarray, width: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``width`` words that lies in one row.

    ``second`` gives a hash that is independent of the first.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    q = _Q[second]
    inverse = np.uint64(pow(int(q), -1, 2**64))
    power = np.ones(n, np.uint64)
    power[1:] = q
    power = np.multiply.accumulate(power)
    back = np.ones(n, np.uint64)
    back[1:] = inverse
    back = np.multiply.accumulate(back)
    base = mix(hashes + np.uint64(0x51ED270B)) if second else hashes
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(base * power, out=total[1:])
    left = words.count - (width - 1)
    at = starts(words.first[:-1][left > 0], left[left > 0])
    return at, mix((total[at + width] - total[at]) * back[at])


def starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(f, f + c)`` for the given pairs."""
    if not len(count):
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(count.sum(), dtype=np.int64) + np.repeat(first - before, count)
