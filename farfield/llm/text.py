"""Vectorised word and n-gram hashing over Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit: a word's is a polynomial over
a fixed random table of byte values, finalised by a mixer; an n-gram's is a polynomial over its words' hashes.
All functions work on blocks of documents of bounded size, whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
BLOCK_ROWS = 2048
_RNG = np.random.default_rng(20240917)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base & (2**64 - 1))
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close sums land far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


class Block:
    """Some documents of a batch: ``first`` is the row of the first; words of document k are ``bounds[k]:bounds[k+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.rows = first, len(offsets) - 1
        self.base = int(offsets[0])
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.data = data[self.base : int(offsets[-1])]
        solid = ~_SPACE[self.data]
        n = len(solid)
        begin, end = solid.copy(), solid.copy()
        if n:
            cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            begin[1:] &= ~solid[:-1]
            begin[cut] = solid[cut]
            end[:-1] &= ~solid[1:]
            end[cut - 1] = solid[cut - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def text_bytes(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def word_hashes(self, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends, table if table is not None else _LOWER if lower else _TABLE)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * powers(_P, n), out=sums[1:])
        inverse = powers(pow(_P, -1, 2**64), n + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the spans one after the other with a space after each, and their bounds."""
        sizes = ends - starts + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
        out = self.data[np.minimum(at, max(0, len(self.data) - 1))]
        out[bounds[1:] - 1] = 32
        return out, bounds


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, most: int = BLOCK_ROWS) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes and at most ``most`` rows; a longer document is a block of its own."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, first + most, max(first + 1, last))
        yield Block(data, offsets[first : last + 1], first)
        first = last


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on; shorter than ``words`` by k - 1 (empty if there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 6:
        out = words[:n].copy()
        for j in range(1, k):
            out += words[j : j + n] * powers(_Q, k)[j]
        return mix(out)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_Q, len(words)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(pow(_Q, -1, 2**64), n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def sparse(rows: np.ndarray) -> list[pa.Array]:
    """The places and values other than zero of each row of a matrix, as two list columns."""
    row, at = np.nonzero(rows)
    ends = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), rows[row, at].astype(np.float32))]


def dense(places: list[np.ndarray], values: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(places), width), np.float32)
    for k, (at, x) in enumerate(zip(places, values, strict=True)):
        out[k, at] = x
    return out
