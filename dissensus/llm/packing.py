"""Packing of token sequences by patterns of few documents.

Documents are encoded, and those longer than a sequence are cut. The histogram of the
pieces' lengths is then fitted, by non-negative least squares, with repeated patterns: few
lengths that fill a sequence. The fit's repeat counts are rounded down, and what they
leave over is packed by best fit, the longest first, also into the gaps of the patterns.
All of this works on the histogram, whose size is that of a sequence, never on documents.
A piece finds its place from its number among the pieces of its length.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissensus.llm import pretokens, tokenfiles
from dissensus.session import written

SEQUENCE = 2048
END_ID = 0
# Lengths are fitted in this many bins, each counted as its longest length.
BINS = 128
# Documents of a pattern.
PATTERN_DOCS = 3
# Pieces shorter than this part of a sequence are no part of patterns: they fill the gaps
# that bins and rounding leave.
FILLERS = 8

# What the vocabulary's rules match as a whole, lower-cased, and write as it is: its merges
# alone give the ids.
PLAIN = re.compile(r"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")

Pattern = tuple[int, ...]  # lengths, the longest first


@functools.cache
def coder(path: str) -> pretokens.Memo:
    """The tokenizers library over the parts of a text of ``pretokens.part_starts``, across
    which the vocabulary's own rules match nothing. Texts that hold an added token of the
    vocabulary are encoded whole (``tokenfiles.marked``)."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    tokenizer = Tokenizer.from_file(path)

    model = tokenizer.model

    def encode(parts: list[str]) -> list[list[int]]:
        low = [part.strip(" \t\r\n").lower() for part in parts]
        plain = [PLAIN.fullmatch(part) is not None for part in low]
        rest = iter(tokenizer.encode_batch([part for part, one in zip(parts, plain) if not one], add_special_tokens=False))
        return [[token.id for token in model.tokenize(part)] if one else next(rest).ids for part, one in zip(low, plain)]

    return pretokens.Memo(encode, starts=pretokens.part_starts)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``key, piece, start, length, ids_crc32, task, place``: each document's ids and
    ``end_id``, cut into pieces of ``size``; the last one may be shorter.

    ``place`` numbers the pieces of one length within a task, from 0. Null and empty texts
    are one piece, the ``end_id``. Null keys and repeated rows are kept as they are.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = source.select("key").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "integer"), ("place", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        memo, task = coder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for lo, hi, texts in pretokens.blocks(batch, "text"):
                coded = tokenfiles.spliced(memo.texts(texts), tokenfiles.marked(path)(texts))
                ids = np.insert(coded.ids.astype("<u4"), coded.bounds[1:], end_id)
                tokens = np.diff(coded.bounds) + 1
                count = -(-tokens // size)
                row = np.repeat(np.arange(len(texts)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, tokens[row] - start)
                at = (np.cumsum(tokens) - tokens)[row] + start
                sums = [zlib.crc32(ids[a : a + n].data) for a, n in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                distinct, first, many = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(row), dtype=np.int64)
                place[order] = np.arange(len(row)) - np.repeat(first, many) + seen[length[order]]
                seen[distinct] += many
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(sums, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(place)],
                    names=["key", "piece", "start", "length", "ids_crc32", "task", "place"],
                )

    return source.mapInArrow(run, schema)


def patterns_of(total: int, docs: int = PATTERN_DOCS, least: int = 1) -> list[tuple[int, ...]]:
    """All ways to make ``total`` of 1 to ``docs`` whole numbers of at least ``least``."""
    out = [(total,)] if total >= least else []
    if docs > 1:
        for low in range(least, total // 2 + 1):
            out += [(*rest, low) for rest in patterns_of(total - low, docs - 1, low)]
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 with the least ||a x - b||, by Lawson and Hanson's active sets. It has at
    most as many numbers above 0 as a has rows."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    slack = 1e-10 * max(1.0, np.abs(a.T @ b).max())
    for _ in range(3 * n):
        gradient = np.where(inside, -np.inf, a.T @ (b - a @ x))
        if inside.all() or gradient.max() <= slack:
            break
        entered = int(gradient.argmax())
        inside[entered] = True
        while True:
            at = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > slack).all():
                break
            # Go as far as no number falls below 0, and put those that reach it aside.
            down = z <= slack
            held = x[at[down]]
            share = np.min(held / np.maximum(held - z[down], 1e-300))
            x[at] += share * (z - x[at])
            gone = at[x[at] <= slack]
            inside[gone], x[gone] = False, 0
            if not inside.any():
                break
        x[:] = 0
        if inside.any():
            x[at] = z
        if not inside[entered]:
            break  # rounding: the best column does not help
    return x


def fitted(histogram: np.ndarray, bins: int = BINS) -> list[tuple[Pattern, int]]:
    """Patterns with repeat counts, which together take no length more often than it
    occurs (``histogram[n]`` pieces of length n).

    Bins are fitted; in place of the last length of a pattern, whatever its bin, goes the
    longest one that fits beside the others, so that bins leave no gaps.
    """
    size = len(histogram) - 1
    bins = min(bins, size)
    bin_of = -(-np.arange(size + 1) * bins // size)
    demand = np.bincount(bin_of, histogram, minlength=bins + 1)
    ways = patterns_of(bins, least=-(-bins // FILLERS))
    table = np.zeros((bins, len(ways)))
    for column, way in enumerate(ways):
        for part in way:
            table[part - 1, column] += 1
    fit = non_negative_least_squares(table, demand[1:] / max(1.0, demand.max())) * max(1.0, demand.max())
    rest = histogram.astype(np.int64).tolist()
    alive = [n for n, many in enumerate(rest) if many and n]  # lengths that are left, sorted
    low = [int(np.searchsorted(bin_of, b)) for b in range(bins + 1)]  # shortest length of a bin
    out: Counter[Pattern] = Counter()

    def longest(upto: int, least: int, used: Counter) -> int | None:
        """The longest length from ``least`` to ``upto`` of which more are left than used."""
        at = bisect.bisect_right(alive, upto)
        while at and alive[at - 1] >= least:
            at -= 1
            if rest[alive[at]] > used[alive[at]]:
                return alive[at]
        return None

    for column in np.argsort(-fit, kind="stable").tolist():
        left = int(fit[column])
        while left:
            made: Counter[int] = Counter()
            # All but the last come from their bins; the last is the longest that fits.
            for b in ways[column][:-1]:
                n = longest(b * size // bins, low[b], made)
                if n is None:
                    break
                made[n] += 1
            else:
                n = longest(size - sum(made.elements()), 1, made)
                if n is not None:
                    made[n] += 1
            if n is None:
                break
            times = min(left, *[rest[n] // m for n, m in made.items()])
            for n, m in made.items():
                rest[n] -= times * m
                if not rest[n]:
                    alive.remove(n)
            out[tuple(sorted(made.elements(), reverse=True))] += times
            left -= times
    return list(out.items())


def packed(histogram: np.ndarray) -> list[tuple[Pattern, int]]:
    """Patterns with repeat counts that hold each piece of the histogram once.

    Starts with ``fitted`` and puts what that leaves over, the longest first, where it
    leaves the smallest gap; a new sequence is begun if it fits nowhere.
    """
    size = len(histogram) - 1
    rest = histogram.astype(np.int64).copy()
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # by free places
    gaps: list[int] = []  # free places that occur, sorted

    def put(pattern: Pattern, times: int) -> None:
        free = size - sum(pattern)
        if free not in open_:
            open_[free] = []
            bisect.insort(gaps, free)
        open_[free].append((pattern, times))

    for pattern, times in fitted(histogram):
        put(pattern, times)
        np.subtract.at(rest, np.array(pattern), times)
    for length in np.flatnonzero(rest)[::-1].tolist():
        left = int(rest[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                free = gaps[at]
                pattern, times = open_[free].pop()
                if not open_[free]:
                    del open_[free], gaps[at]
            else:
                free, pattern, times = size, (), -(-left * length // size) + left
            # The gap that is left after one is the smallest again while another fits.
            each = min(left, free // length)
            used = min(times, left // each)
            put(pattern + (length,) * each, used)
            if pattern and times > used:
                put(pattern, times - used)
            left -= used * each
    return [pair for free in sorted(open_) for pair in open_[free]]


class Places:
    """Where the pieces of each length go: the n-th of its length has a sequence and an
    offset. Sequences of one pattern have consecutive numbers."""

    def __init__(self, patterns: list[tuple[Pattern, int]], size: int):
        length, many, times, sequence, offset = [], [], [], [], []
        first = 0
        for pattern, repeats in patterns:
            at = 0
            for n, m in sorted(Counter(pattern).items(), reverse=True):
                for values, value in ((length, n), (many, m), (times, repeats), (sequence, first), (offset, at)):
                    values.append(value)
                at += n * m
            first += repeats
        self.sequences = first
        length, many, times, sequence, offset = (np.array(x, dtype=np.int64) for x in (length, many, times, sequence, offset))
        order = np.argsort(length, kind="stable")
        self.many, self.sequence, self.offset = many[order], sequence[order], offset[order]
        held = (many * times)[order]
        self.before = np.cumsum(held) - held  # pieces of all lengths before an entry
        firsts = np.searchsorted(length[order], np.arange(size + 2))
        self.of_length = np.append(self.before, held.sum())[firsts]

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of the pieces with these numbers among their length."""
        at = self.of_length[length] + number
        entry = np.searchsorted(self.before, at, side="right") - 1
        inside = at - self.before[entry]
        return self.sequence[entry] + inside // self.many[entry], self.offset[entry] + inside % self.many[entry] * length


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    Pieces are those of ``pieces``. Sequences are numbered from 0 and filled from offset 0
    without gaps; which of several pieces of one length goes where follows their tasks and
    places there. An empty table gives no rows. The driver sees the histogram alone.
    """
    held = written(pieces(docs, path, key, text, size, end_id), "pieces")
    counts = held.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # A row per task and length, not per piece.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        histogram[length] = n
    places = Places(packed(histogram), size)
    # Bounded by the lengths: some thousand patterns.
    shared = docs.sparkSession.sparkContext.broadcast(places)
    numbered = held.join(counts.select("task", "length", "base"), ["task", "length"])
    source = numbered.select("key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("number"))
    schema = source.drop("number").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            found = [pa.array(x) for x in shared.value.of(length, number)]
            columns = [batch.column(c) for c in schema.names[:5]]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
