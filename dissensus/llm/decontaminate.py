"""Documents that hold passages of a benchmark.

Windows as long as the items slide over the words of a document, each with a SimHash of
its weighted words. A fingerprint is cut into blocks: two that differ in at most RADIUS
bits agree up to one bit in some block, so a table of all such block values finds every
fingerprint within the radius. Candidates are compared by their weighted shingles.

Item lengths fall into classes. The windows of a class have COVER of the words of its
shortest item, so that a passage which lost words at an end still has whole windows. They
begin at every STRIDE-th word of a document and at each word of an item: wherever an item
stands, a window of the document and one of the item cover the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus.llm import words as W

SIMILARITY = 0.8
BITS = 64
BLOCKS = 4
# A bit of difference a block: 2 * BLOCKS - 1 bits are found for certain.
RADIUS = 2 * BLOCKS - 1
STRIDE = 3
COVER = 0.8
GROWTH = 1.25  # from a length class to the next
SLACK = 2  # words an item may have moved by, after words were put in or left out
# Items the driver and each worker may hold; about 1 KB each.
MAX_ITEMS = 1_000_000


@dataclass
class LengthClass:
    """Fingerprints of item windows of one length, and tables of their blocks."""

    window: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # present, first, entries


@dataclass
class Index:
    keys: list
    sizes: np.ndarray  # words per item
    shingles: list[dict[int, float]]  # weight by shingle
    known: np.ndarray  # sorted word hashes of the benchmark
    weights: np.ndarray  # theirs; a word that is in no item weighs most
    top: int
    classes: list[LengthClass]
    words: list[np.ndarray]  # word hashes of each item
    kind: type  # of sums of weights, which hold those of the longest window

    def word_weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), self.top, np.uint8)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.weights[at], self.top).astype(np.uint8)


def prints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, window: int, sums=None) -> np.ndarray:
    """SimHashes of the windows at ``starts``: a bit is set if words with more than half
    of the window's weight have it set."""
    ones, total = sums or running(hashes, weights)
    # Sums run on modulo the size of their kind; a window weighs less than that.
    inside = ones[starts + window] - ones[starts]
    half = ((total[starts + window] - total[starts]) // 2).astype(ones.dtype)[:, None]
    return np.packbits(inside > half, axis=1, bitorder="little").view(np.uint64)[:, 0]


def running(hashes: np.ndarray, weights: np.ndarray, kind: type = np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights of the words before each place: of those that have each bit
    set, and of all."""
    bits = np.unpackbits(W.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits *= weights[:, None]
    ones = np.zeros((len(hashes) + 1, BITS), dtype=kind)
    np.cumsum(bits, axis=0, dtype=kind, out=ones[1:])
    total = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.cumsum(weights, out=total[1:])
    return ones, total


def near_values(values: np.ndarray) -> np.ndarray:
    """Block values and all that differ from them in one bit, by row."""
    flips = np.concatenate([[0], 1 << np.arange(BITS // BLOCKS)]).astype(np.uint16)
    return values[:, None] ^ flips


def build(keys: list, texts: list[str | None]) -> Index:
    """The index of a benchmark. Items without words have no windows."""
    if len(keys) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items: split the benchmark")
    w = W.word_hashes(texts)
    sizes = np.diff(w.bounds)
    rows, values, _ = W.counted(w.hashes, w.rows())
    known, held_by = np.unique(values, return_counts=True)
    # Words of few items weigh 3, those of many 1.
    few, many = max(1, 0.02 * len(keys)), max(1, 0.2 * len(keys))
    weights = np.where(held_by <= few, 3, np.where(held_by <= many, 2, 1)).astype(np.uint8)
    # Bytes are enough for windows of up to 85 words.
    heaviest = 3 * COVER * int(sizes.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if heaviest <= np.iinfo(k).max)
    parts = [w.hashes[lo:hi] for lo, hi in zip(w.bounds, w.bounds[1:])]
    index = Index(list(keys), sizes, [], known, weights, 3, [], parts, kind)
    every = index.word_weights(w.hashes)
    for lo, hi in zip(w.bounds, w.bounds[1:]):
        index.shingles.append(weighted(w.hashes[lo:hi], every[lo:hi]))
    sums = running(w.hashes, every, kind)
    lengths = np.unique(sizes[sizes > 0])
    while len(lengths):
        members = lengths[lengths < max(lengths[0] * GROWTH, lengths[0] + 1)]
        lengths = lengths[len(members) :]
        window = int(max(1, COVER * members[0] - STRIDE + 1))
        found, items, offsets = [], [], []
        for i in np.flatnonzero(np.isin(sizes, members)):
            at = np.arange(sizes[i] - window + 1)
            found.append(prints(w.hashes, every, w.bounds[i] + at, window, sums))
            items.append(np.full(len(at), i))
            offsets.append(at)
        found, items, offsets = map(np.concatenate, (found, items, offsets))
        blocks = []
        for k in range(BLOCKS):
            values = near_values(((found >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.uint16))
            entries = np.repeat(np.arange(len(found)), values.shape[1])
            order = np.argsort(values.ravel(), kind="stable")
            count = np.bincount(values.ravel(), minlength=1 << 16)
            first = np.concatenate([[0], np.cumsum(count)])
            blocks.append((count > 0, first, entries[order]))
        index.classes.append(LengthClass(window, found, items, offsets, blocks))
    return index


def weighted(hashes: np.ndarray, weights: np.ndarray) -> dict[int, float]:
    """Weights of the shingles of a run of words: those of their words, added up over
    all places of a shingle."""
    w = W.Words(hashes, np.zeros(0), np.zeros(0), np.array([0, len(hashes)]))
    found, _ = W.shingles(w)
    out: dict[int, float] = {}
    for i, s in enumerate(found.tolist()):
        out[s] = out.get(s, 0.0) + float(weights[i : i + W.SHINGLE_WORDS].sum())
    return out


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    """Weighted Jaccard similarity."""
    both = sum(min(x, b[k]) for k, x in a.items() if k in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


def near(c: LengthClass, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (window, fingerprint of an item) within RADIUS bits."""
    at, which = [], []
    for k, (present, first, entries) in enumerate(c.blocks):
        values = ((found >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
        hit = np.flatnonzero(present[values])
        size = first[values[hit] + 1] - first[values[hit]]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[values[hit]] - ends + size, size)
        at.append(np.repeat(hit, size))
        which.append(entries[take])
        close = np.bitwise_count(found[at[-1]] ^ c.prints[which[-1]]) <= RADIUS
        at[-1], which[-1] = at[-1][close], which[-1][close]
    return np.concatenate(at), np.concatenate(which)


def matches(index: Index, w: W.Words) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of the best place of each item found;
    of places alike, the first that the windows of the shortest class meet."""
    n = len(w.hashes)
    every = index.word_weights(w.hashes)
    sums = running(w.hashes, every, index.kind)
    counts = np.diff(w.bounds)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    rows = w.rows()
    place = np.arange(n) - np.repeat(w.bounds[:-1], counts)
    left = np.repeat(counts, counts) - place
    even = place % STRIDE == 0
    for c in index.classes:
        starts = np.flatnonzero(even & (left >= c.window))
        if not len(starts):
            continue
        found = prints(w.hashes, every, starts, c.window, sums)
        for a, p in zip(*map(np.ndarray.tolist, near(c, found))):
            item, row = int(c.items[p]), int(rows[starts[a]])
            begin = int(starts[a] - c.offsets[p] - w.bounds[row])
            if (row, item, begin) in tried or best.get((row, item), (0.0,))[0] == 1.0:
                continue
            tried.add((row, item, begin))
            size = int(index.sizes[item])
            for move in sorted(range(-SLACK, SLACK + 1), key=abs):
                lo = max(0, begin + move)
                hi = min(int(counts[row]), lo + size)
                s = slice(int(w.bounds[row]) + lo, int(w.bounds[row]) + hi)
                alike = similarity(weighted(w.hashes[s], every[s]), index.shingles[item])
                if alike >= SIMILARITY and alike > best.get((row, item), (0.0,))[0]:
                    best[row, item] = (alike, lo, hi - lo)
                if alike == 1.0:
                    break
            else:
                # A passage may have lost words at an end: from the first to the last
                # word that agrees.
                first = max(0, -begin)
                there = w.hashes[w.bounds[row] + begin + first : min(w.bounds[row] + begin + size, w.bounds[row + 1])]
                agree = np.flatnonzero(there == index.words[item][first : first + len(there)])
                if len(agree):
                    lo, hi = begin + first + int(agree[0]), begin + first + int(agree[-1]) + 1
                    s = slice(int(w.bounds[row]) + lo, int(w.bounds[row]) + hi)
                    alike = similarity(weighted(w.hashes[s], every[s]), index.shingles[item])
                    if alike >= SIMILARITY and alike > best.get((row, item), (0.0,))[0]:
                        best[row, item] = (alike, lo, hi - lo)
    return [(row, item, *found) for (row, item), found in sorted(best.items())]


def load(benchmark: DataFrame, item: str, text: str) -> Index:
    """Index of a benchmark table; MAX_ITEMS bounds what is collected."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).limit(MAX_ITEMS + 1).collect()
    rows.sort(key=lambda r: (str(r["item"]), r["text"] or ""))
    return build([r["item"] for r in rows], [r["text"] for r in rows])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``key, item, similarity, first_word, n_words``: the best place of each item that a
    document holds with a weighted shingle similarity of SIMILARITY or more.

    One row per document and item, and per repeated row of either table. Documents
    without such a passage, null and empty texts have no row; an empty benchmark matches
    nothing. Items of fewer than five words are one shingle. No shuffle: the benchmark,
    of at most MAX_ITEMS items, is sent to the workers.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    item_type = benchmark.select(F.col(item).alias("item")).schema["item"].dataType
    schema = source.select("key").schema.add("item", item_type)
    for name, kind in (("similarity", "double"), ("first_word", "long"), ("n_words", "long")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(load(benchmark, item, item_text))
    def run(batches):
        index = shared.value
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            for lo, hi in W.chunks(offsets, 1 << 18):
                w = W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found = matches(index, w)
                if found:
                    row, which, alike, first, size = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array([lo + r for r in row])), pa.array([index.keys[i] for i in which]),
                         pa.array(alike, pa.float64()), pa.array(first, pa.int64()), pa.array(size, pa.int64())],
                        names=["key", "item", "similarity", "first_word", "n_words"],
                    )

    return source.mapInArrow(run, schema).withColumnsRenamed({"key": key, "item": item})


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns, in one pass.
    Null and empty texts hold none."""
    shared = docs.sparkSession.sparkContext.broadcast(load(benchmark, item, item_text))

    def run(batches):
        index = shared.value
        for batch in batches:
            data, offsets = W.utf8(batch.column(text).cast(pa.string()))
            for lo, hi in W.chunks(offsets, 1 << 18):
                found = matches(index, W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                stays = np.ones(hi - lo, dtype=bool)
                stays[[m[0] for m in found]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
