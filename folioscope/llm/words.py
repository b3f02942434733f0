"""Words of whole Arrow text columns as arrays: boundaries, hashes, n-grams.

A column is worked off in blocks of a bounded number of text bytes (one row at least), so the
arrays of a task stay small whatever the batch holds. ``word_hashes`` is a polynomial modulo 2^64: it only groups or
pre-selects, for operators that then compare words or carry more bits. ``word_keys`` adds scrambled (place, byte) pairs and
may stand for words where nothing else is compared: equal keys of different words are a matter of 64-bit chance alone, with
no structure of a word that makes them meet. ``packed_words`` gives the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(excluded: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[excluded] = False
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(list(SPACES))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALPHANUMERIC = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, grown as needed."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Block(NamedTuple):
    """Words of consecutive rows of a column."""

    row: int  # position of the first row in the column
    data: np.ndarray  # text bytes of the rows, one after another
    offsets: np.ndarray  # of each row in data, and the end
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int64), self.counts)

    def word_hashes(self) -> np.ndarray:
        powers, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((self.data + U64(1)) * powers[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def word_keys(self) -> np.ndarray:
        """Hashes that may stand for the words: the sum of a scrambled value for each (place in the word, byte)."""
        sums = np.zeros(len(self.data) + 1, dtype=U64)
        place = np.arange(len(self.data), dtype=U64)
        lengths = self.ends - self.starts
        inside = np.repeat(self.starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else self.starts, lengths)
        at = (np.arange(len(inside)) + inside).astype(np.int64)  # positions of all letters
        place = place[at] - np.repeat(self.starts, lengths).astype(U64)
        sums[at + 1] = mix(((place << U64(8)) | self.data[at]) + U64(0x632BE59BD9B4E019))
        np.cumsum(sums, out=sums)
        return mix(sums[self.ends] - sums[self.starts] + lengths.astype(U64))

    def code_points_before(self) -> np.ndarray:
        """Code points before each byte position."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def words(self, start: int, end: int) -> list[bytes]:
        raw = self.data.tobytes() if end - start > 1000 else None
        if raw is not None:
            return [raw[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())]
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, word_bytes: np.ndarray = SPACED, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``size`` bytes of a text column in row order; ``lower`` turns A-Z into a-z first."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        last = max(last, row + 1)
        own = data[offsets[row] : offsets[last]]
        if lower:
            own = np.where((own >= 65) & (own <= 90), own | 32, own).astype(np.uint8)
        yield _block(row, own, offsets[row : last + 1] - offsets[row], word_bytes)
        row = last


def _block(row: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Block:
    inside = word_bytes[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Block(row, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside a row, and the index of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(len(hashes) - n + 1, dtype=U64)
    for i in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - n + 1 + i])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    at = np.flatnonzero(left >= n)
    return out[at], at


def spans_union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are covered by any span."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def single_spaced(b: Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The rows' words with one space after each, and where every word starts and ends in that."""
    inside = np.zeros(len(b.data) + 1, dtype=bool)
    change = np.zeros(len(b.data) + 1, dtype=np.int8)
    np.add.at(change, b.starts, 1)
    np.add.at(change, b.ends, -1)
    inside[:] = np.cumsum(change) > 0
    lengths = b.ends - b.starts
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(lengths) else lengths
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    source = np.flatnonzero(inside[:-1])
    out[source - np.repeat(b.starts - starts, lengths)] = b.data[source]
    return out.tobytes(), starts, starts + lengths


def packed_words(b: Block) -> pa.Array:
    """All words of a block as one string column, in order."""
    change = np.zeros(len(b.data) + 1, dtype=np.int8)
    change[b.starts] += 1
    change[b.ends] -= 1  # a word ends where the next row's word may begin
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    offsets = np.zeros(len(b.starts) + 1, dtype=np.int64)
    np.cumsum(b.ends - b.starts, out=offsets[1:])
    letters = b.data[inside]
    kind, width = (pa.string(), np.int32) if len(letters) < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(b.starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(letters)])
