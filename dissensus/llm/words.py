"""Words, word hashes and shingles of Arrow text columns, as numpy arrays.

A word is a longest run of ASCII letters and digits and of non-ASCII characters;
``A-Z`` are lower-cased. All functions work on the UTF-8 bytes of a whole column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE_WORDS = 5
# Bytes of text handled at once; bounds the arrays of a task (about 30 bytes per byte).
CHUNK_BYTES = 1 << 20


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    word = np.zeros(256, dtype=bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        word[lo : hi + 1] = True
    return np.where(word, table, 0).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scattered(terms: np.ndarray) -> np.ndarray:
    """Terms of a polynomial made independent of each other, in place: sums of plain ones
    are equal for some pairs of sequences, whatever the base (Thue-Morse words)."""
    terms ^= terms >> np.uint64(32)
    terms *= np.uint64(0xBF58476D1CE4E5B9)
    terms ^= terms >> np.uint64(29)
    return terms


LOWER = _lower_table()
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
BASE = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 4096)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """``hashes`` of the words of all rows; those of row i are ``bounds[i]:bounds[i+1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of rows given as bytes and offsets (offsets[0] is 0)."""
    low = LOWER[data]
    inside = low != 0
    n = len(low)
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False  # a row's first byte follows no word
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    lengths = ends - starts
    if len(starts):
        at = np.flatnonzero(inside)
        first = np.zeros(len(starts), dtype=np.int64)
        np.cumsum(lengths[:-1], out=first[1:])
        place = np.arange(len(at)) - np.repeat(first, lengths)
        terms = scattered(SYMBOLS[low[at]] * powers(int(lengths.max()))[place])
        hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * GOLDEN)
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(hashes, starts, lengths, np.searchsorted(starts, offsets))


def word_hashes(texts: list[str | None]) -> Words:
    return words(*utf8(pa.array(texts, pa.string())))


def shingles(w: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their row bounds.

    A row of 1 to size-1 words has one shingle, all its words; an empty row has none.
    """
    counts = np.diff(w.bounds)
    n = len(w.hashes)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(per_row, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - w.bounds[:-1], per_row)
    left = np.repeat(w.bounds[1:], per_row) - at
    padded = np.concatenate([w.hashes, np.zeros(size, dtype=np.uint64)])
    out = np.zeros(len(at), dtype=np.uint64)
    for k, p in enumerate(powers(size + 1, np.uint64(0xA24BAED4963EE407))[1:]):
        word = padded[at + k] if n else np.zeros(0, np.uint64)
        out += np.where(left > k, mix(word + np.uint64(k)), np.uint64(0)) * p
    return mix(out), bounds


def counted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) with their counts, ordered by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], values[first], np.diff(np.append(first, len(values)))
