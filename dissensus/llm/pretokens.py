"""Splits texts the way byte-level BPE does before it merges, on whole columns.

The split is that of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A piece is then encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex

from dissensus.llm import words as W

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# Letters that may follow an apostrophe; fixed values of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Pieces a worker keeps, and the characters they may have together.
KEPT_PIECES = 600_000
KEPT_CHARACTERS = 1 << 24


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            out[lo : hi + 1] = kind
    return out


@functools.cache
def symbols() -> np.ndarray:
    """A random-looking 64-bit number for every code point."""
    return W.mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * W.GOLDEN)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the bounds of each text."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), bounds


def starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a piece begins."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[cp]
    new = np.ones(n, dtype=bool)  # a run of one class begins, or a text
    new[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    new |= first[:-1]
    blank = cp == 32
    begin = new.copy()
    # White space before another class of the same text: its last character stands
    # apart, and, if it is a blank, goes with what follows.
    edge = np.flatnonzero(new & ~first[:-1] & (kind != SPACE))
    edge = edge[kind[edge - 1] == SPACE]
    begin[edge - 1] = True
    begin[edge[blank[edge - 1]]] = False
    # An apostrophe that begins a piece takes the letters of a contraction.
    marks = np.flatnonzero(begin & (cp == 39))
    padded = np.append(cp, [0, 0])
    ends = np.append(first, [True, True])
    for p in marks:
        if ends[p + 1]:
            continue
        a = chr(padded[p + 1])
        if a in CONTRACTIONS:
            size = 2
        elif not ends[p + 2] and a + chr(padded[p + 2]) in CONTRACTIONS:
            size = 3
        else:
            continue
        begin[p + 1 : p + size] = False
        if p + size < n:
            after = p + size
            # The rest of the word is a piece of its own; a blank was marked already.
            if kind[after] == LETTER:
                begin[after] = True
    return np.flatnonzero(begin)


def part_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a text, a run of ASCII white space, an ASCII digit or a run of ASCII letters
    or of other ASCII signs begins; white space goes with what follows. An apostrophe
    and the letters after it, and all that touches other characters, stay together.

    Patterns that match runs of letters, single digits, runs of signs and contractions,
    but no white space, match nothing across these borders.
    """
    if not len(cp):
        return np.zeros(0, dtype=np.int64)
    blank = (cp == 32) | (cp == 10) | (cp == 13) | (cp == 9)
    lower = cp | np.uint32(32)
    letter, digit = (lower >= 97) & (lower <= 122), (cp >= 48) & (cp <= 57)
    kind = np.where(letter, 1, np.where(digit, 2, np.where(cp < 128, 3, 4))).astype(np.uint8)
    kind[blank] = 0
    before, after = kind[:-1], kind[1:]
    cut = (before != after) & (before != 0) & (before != 4) & (after != 4) & ~((cp[:-1] == 39) & (after == 1))
    new = np.ones(len(cp) + 1, dtype=bool)
    new[1:-1] = cut | ((before == 2) & (after == 2)) | ((after == 0) & (before != 0))
    new[bounds] = True
    return np.flatnonzero(new[:-1])


def space_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a text or a run of blanks begins; a run goes with the characters after it."""
    if not len(cp):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(cp) + 1, dtype=bool)
    new[1:-1] = (cp[1:] == 32) & (cp[:-1] != 32)
    new[bounds] = True
    return np.flatnonzero(new[:-1])


@dataclass
class Coded:
    """Ids of all texts: those of text i are ``ids[bounds[i]:bounds[i+1]]``."""

    ids: np.ndarray
    bounds: np.ndarray


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, where each stands first, and which of them each
    key is. All keys are hashed, only distinct ones are sorted."""
    found = pa.array(keys).dictionary_encode()
    distinct, which = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    # The dictionary has the keys in the order they come first.
    one = np.empty(len(order), dtype=np.int64)
    one[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return distinct[order], one[order], rank[which]


class Memo:
    """Ids of pieces seen so far.

    ``encode`` maps a list of pieces to a list of id sequences, ``starts`` finds where the
    pieces of some texts begin. A piece is looked up by a 64-bit hash and then compared
    with the piece that is kept there, character by character; one that only has the same
    hash is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[str]], list], kept: int = KEPT_PIECES, starts: Callable = starts):
        self.encode, self.kept, self.starts = encode, kept, starts
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.place = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)  # bounds of the ids of each piece kept
        self.ids = np.zeros(0, dtype=np.uint32)
        self.begins = np.zeros(1, dtype=np.int64)  # bounds of its characters
        self.characters = np.zeros(0, dtype=np.uint32)

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces and how many each has."""
        coded = self.encode(pieces)
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        return np.fromiter(itertools.chain.from_iterable(coded), dtype=np.uint32, count=int(lengths.sum())), lengths

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        flat, lengths = self._coded(pieces)
        place = np.arange(len(self.first) - 1, len(self.first) - 1 + len(keys))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, flat])
        characters, bounds = codepoints(pieces)
        self.begins = np.concatenate([self.begins, self.begins[-1] + bounds[1:]])
        self.characters = np.concatenate([self.characters, characters])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.place = every[order], np.concatenate([self.place, place])[order]

    def texts(self, texts: list[str]) -> Coded:
        cp, bounds = codepoints(texts)
        begin = self.starts(cp, bounds)
        if not len(begin):
            return Coded(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        lengths = np.diff(np.append(begin, len(cp)))
        place = np.arange(len(cp)) - np.repeat(begin, lengths)
        terms = symbols()[cp] * W.powers(int(lengths.max()))[place]
        keys = W.mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64) * W.GOLDEN)
        distinct, one, which = grouped(keys)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        whole = "".join(texts)
        piece = lambda at: [whole[s : s + k] for s, k in zip(begin[at].tolist(), lengths[at].tolist())]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.kept or len(self.characters) > KEPT_CHARACTERS:
                self.clear()  # this block's pieces are all added again
                known[:] = False
            fresh = np.flatnonzero(~known)
            self._add(distinct[fresh], piece(one[fresh]))
            at = np.searchsorted(self.keys, distinct)
        slot = self.place[at][which]
        start, count = self.first[slot], self.first[slot + 1] - self.first[slot]
        ids = self.ids
        # Two different pieces may have one hash.
        other = np.diff(self.begins)[slot] != lengths
        kept = np.repeat(self.begins[slot], lengths) + place
        if other.any():
            kept[np.repeat(other, lengths)] = 0
        other |= np.logical_or.reduceat(self.characters[kept] != cp, begin)
        if other.any():
            flat, own = self._coded(piece(other))
            start[other] = len(ids) + np.cumsum(own) - own
            count[other] = own
            ids = np.concatenate([ids, flat])
        ends = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(count, out=ends[1:])
        take = np.arange(ends[-1]) + np.repeat(start - ends[:-1], count)
        return Coded(ids[take], ends[np.searchsorted(begin, bounds)])


def blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a batch of bounded size with their texts; null is empty."""
    _, offsets = W.utf8(batch.column(column))
    for lo, hi in W.chunks(offsets, limit):
        yield lo, hi, batch.column(column).slice(lo, hi - lo).fill_null("").to_pylist()
