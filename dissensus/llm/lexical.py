"""Ranked lexical search over all documents for a set of items, by lengths of vectors.

A document is a vector of impacts over the items' terms. Vectors are ordered by length
into buckets. For an item, a bucket is passed over if no inner product with a vector of
its greatest length can reach the item's threshold (Cauchy-Schwarz); inside a bucket the
item's heaviest coordinates and the length of the rest bound each product, and what may
reach the threshold is scored again, exactly, in whole numbers. Thresholds come from the
longest vectors of the corpus first, and rise with the scores a task finds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissensus.llm import words as W
from dissensus.session import configure, written

TOP = 20
# Fixed values of the score.
IMPACT, WEIGHT, PART, LENGTH_PART = 1_000_000_000, 1000, 12, 25
# Items that are searched for at once; more are searched for in several passes.
ITEMS = 1 << 14
# Vectors of one bucket.
BUCKET = 2048
# Coordinates of an item that are looked at before a vector is scored.
FOCUS = 8
# Classes of vector lengths to the power of two, and the share of vectors, the longest
# ones, that give the first thresholds.
LENGTH_CLASSES = 4
FIRST_SHARE = 32
# Bounds are in doubles: what comes this close to a threshold is scored.
SLACK = 1e-9


class Terms:
    """Distinct terms, found by hash and then compared letter by letter."""

    def __init__(self, terms: list[str]):
        found = W.word_hashes(terms)
        assert np.array_equal(found.bounds, np.arange(len(terms) + 1))
        order = np.argsort(found.hashes, kind="stable")
        self.hashes, self.index = found.hashes[order], order
        data, offsets = W.utf8(pa.array(terms, pa.string()))
        self.data, self.first, self.lengths = W.LOWER[data], offsets[:-1][order], np.diff(offsets)[order]

    def of(self, data: np.ndarray, w: W.Words) -> np.ndarray:
        """For each word of ``w``, which are words of ``data``, its term or -1."""
        out = np.full(len(w.hashes), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        low = W.LOWER[data]
        left = np.arange(len(out))
        at = np.searchsorted(self.hashes, w.hashes)
        while len(left):
            able = at < len(self.hashes)
            able[able] = self.hashes[at[able]] == w.hashes[left[able]]
            left, at = left[able], at[able]
            equal = self.lengths[at] == w.lengths[left]
            word, term = left[equal], at[equal]
            size = w.lengths[word]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            alike = low[np.repeat(w.starts[word], size) + inside] == self.data[np.repeat(self.first[term], size) + inside]
            if len(word):
                equal[equal] = np.logical_and.reduceat(alike, np.cumsum(size) - size)
            out[left[equal]] = self.index[at[equal]]
            # Another term may have the same hash.
            left, at = left[~equal], at[~equal] + 1
        return out


@dataclass
class Items:
    """Items as terms with numbers of occurrences; ``names[i]`` is the index of the row."""

    names: list
    terms: list[str]
    ids: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> "Items":
        place: dict[str, int] = {}
        names, ids, times = [], [], []
        for name, text in rows:
            held = Counter(words_of(text))
            if held:
                names.append(name)
                ids.append(np.array([place.setdefault(t, len(place)) for t in held], dtype=np.int64))
                times.append(np.array(list(held.values()), dtype=np.int64))
        return cls(names, list(place), ids, times)


def words_of(text: str | None) -> list[str]:
    data, offsets = W.utf8(pa.array([text], pa.string()))
    w, low = W.words(data, offsets), W.LOWER[data]
    return [low[s : s + n].tobytes().decode() for s, n in zip(w.starts.tolist(), w.lengths.tolist())]


def postings(docs: DataFrame, terms: Terms, key: str, text: str) -> DataFrame:
    """``key, n, terms, times`` of documents with at least one word: the number of their
    words, and which of ``terms`` they hold how often."""
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # the words of at most ITEMS items

    def run(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            for lo, hi in W.chunks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                w = W.words(part, offsets[lo : hi + 1] - offsets[lo])
                found = shared.value.of(part, w)
                held = found >= 0
                row, term, times = W.counted(found[held], w.rows()[held])
                count = np.diff(w.bounds)
                some = np.flatnonzero(count)
                bounds = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (term.astype(np.int32), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, hi - lo).take(pa.array(some)), pa.array(count[some]), *lists],
                    names=["key", "n", "terms", "times"],
                )

    return source.mapInArrow(run, "key long, n long, terms array<int>, times array<int>")


def document_counts(held: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches):
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["term", "n"])

    found = held.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)  # as many numbers as the items have terms
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def impacts(held: DataFrame, weights: np.ndarray, documents: int, words: int) -> DataFrame:
    """``key, length, terms, impacts`` of documents that hold a term. ``length`` is that of
    the vector of impacts, each times the root of its term's weight."""
    shared = held.sparkSession.sparkContext.broadcast(np.sqrt(weights))

    def run(batches):
        roots = shared.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            terms, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
            sizes = batch.column("terms").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), sizes)
            share = 100 - LENGTH_PART + LENGTH_PART * n * documents // words
            values = IMPACT * times // (WEIGHT * times + PART * share[row])
            length = np.sqrt(np.bincount(row, (values * roots[terms]) ** 2, minlength=len(n)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            out = [batch.column("key"), pa.array(length), batch.column("terms"), lists]
            yield pa.RecordBatch.from_arrays(out, names=["key", "length", "terms", "impacts"]).filter(pa.array(sizes > 0))

    return held.mapInArrow(run, "key long, length double, terms array<int>, impacts array<long>")


def best_first(scores: np.ndarray, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The order of a ranking: high scores, then low keys, then null keys."""
    return np.lexsort((keys, ~known, -scores))


class Search:
    """Searches buckets of vectors for all items; keeps the TOP best of each item."""

    def __init__(self, items: Items, weights: np.ndarray, least: np.ndarray):
        self.least = least.copy()  # a score that TOP documents reach is needed at least
        self.heavy = [w * t for w, t in zip((weights[i] for i in items.ids), items.times)]
        roots = np.sqrt(weights)
        self.ids, self.of_terms = items.ids, [roots[i] * t for i, t in zip(items.ids, items.times)]
        self.order = [np.argsort(-q, kind="stable")[:FOCUS] for q in self.of_terms]
        self.length = np.array([np.sqrt((q * q).sum()) for q in self.of_terms])
        self.rest = np.array([np.sqrt(max(0.0, (q * q).sum() - (q[o] ** 2).sum())) for q, o in zip(self.of_terms, self.order)])
        self.roots, self.dense = roots, np.zeros(len(weights), dtype=np.int64)
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.best = [nothing] * len(self.ids)

    def add(self, batch: pa.RecordBatch) -> None:
        length = batch.column("length").to_numpy()
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), BUCKET):
            part = batch.take(pa.array(order[lo : lo + BUCKET]))
            if not self._bucket(part):
                break

    def _bucket(self, part: pa.RecordBatch) -> bool:
        """Search one bucket, the longest vector first; False if it, and so all shorter
        ones, can be passed over for all items."""
        length = part.column("length").to_numpy()
        live = np.flatnonzero(self.length * length[0] * (1 + SLACK) >= self.least)
        if not len(live):
            return False
        n = part.num_rows
        terms, values = (part.column(c).flatten().to_numpy() for c in ("terms", "impacts"))
        sizes = part.column("terms").value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(n), sizes)
        by_term = np.argsort(terms, kind="stable")
        firsts = np.searchsorted(terms[by_term], np.arange(len(self.dense) + 1))
        rows, scaled = row[by_term], (values * self.roots[terms])[by_term]
        keys = part.column("key")
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        keys = keys.fill_null(0).to_numpy()
        square = length**2
        for item in live:
            sums, squares = np.zeros(n), np.zeros(n)
            for k in self.order[item]:
                term = self.ids[item][k]
                at = slice(firsts[term], firsts[term + 1])
                sums[rows[at]] += self.of_terms[item][k] * scaled[at]
                squares[rows[at]] += scaled[at] ** 2
            bound = sums + np.sqrt(np.maximum(square - squares, 0)) * self.rest[item] + SLACK * length * self.length[item]
            able = np.flatnonzero(bound >= max(1, self.least[item]) * (1 - SLACK))
            if not len(able):
                continue
            self.dense[self.ids[item]] = self.heavy[item]
            size = sizes[able]
            starts = np.cumsum(size) - size
            flat = np.arange(size.sum()) + np.repeat(ends[able] - size - starts, size)
            scores = np.add.reduceat(self.dense[terms[flat]] * values[flat], starts)
            self.dense[self.ids[item]] = 0
            good = (scores > 0) & (scores >= self.least[item])
            if good.any():
                held = [np.concatenate([x, y]) for x, y in zip(self.best[item], (scores[good], keys[able[good]], known[able[good]]))]
                top = best_first(*held)[:TOP]
                self.best[item] = tuple(x[top] for x in held)
                if len(top) == TOP:
                    self.least[item] = max(self.least[item], self.best[item][0][-1])
        return True

    def found(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        scores, keys, known = (np.concatenate(x) for x in zip(*self.best, none))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(scores), pa.array(keys, mask=~known)], names=["item", "score", "key"])


def searched(vectors: DataFrame, items: Items, weights: np.ndarray, least: np.ndarray) -> DataFrame:
    """``item, score, key``: per task, the TOP best documents of each item of those that
    reach ``least``."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, least))  # at most ITEMS items

    def run(batches):
        search = Search(*shared.value)
        for batch in batches:
            if batch.num_rows:
                search.add(batch)
        yield search.found()

    return vectors.mapInArrow(run, "item long, score long, key long")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (``item, score, key``) with their ``rank``, up to TOP for each item."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def search_slice(docs: DataFrame, rows: list[tuple], key: str, text: str) -> DataFrame | None:
    """``item, score, key, rank`` for some items ``(name, text)``; None without results.
    ``item`` is the place of the item in ``rows``."""
    items = Items.of([(i, content) for i, (_, content) in enumerate(rows)])
    if not items.names:
        return None
    held = written(postings(docs, Terms(items.terms), key, text), "postings")
    documents, words = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    holding = document_counts(held, len(items.terms))
    # Logarithms are those of doubles, one by one.
    weights = np.array([int(np.floor(1000 * float(np.log((2 * documents + 2) / (2 * int(d) + 1))))) for d in holding], dtype=np.int64)
    vectors = written(impacts(held, weights, documents, words), "impact-vectors")
    vectors = vectors.withColumn("class", F.floor(F.log2(F.col("length") + 1) * LENGTH_CLASSES))
    # At most some hundred classes.
    classes = sorted(map(tuple, vectors.groupBy("class").count().collect()), reverse=True)
    first, left = 0, sum(n for _, n in classes) / FIRST_SHARE
    for first, n in classes:
        left -= n
        if left <= 0:
            break
    columns = ["key", "length", "terms", "impacts"]
    long, short = (vectors.filter(c).select(*columns) for c in (F.col("class") >= first, F.col("class") < first))
    least = np.zeros(len(items.names), dtype=np.int64)
    head = written(ranked(searched(long, items, weights, least)), "ranked-longest")
    for item, score in head.filter(F.col("rank") == TOP).select("item", "score").collect():  # a row an item
        least[item] = score
    found = ranked(head.drop("rank").unionByName(searched(short, items, weights, least)))
    places = docs.sparkSession.createDataFrame(pa.table({"item": np.arange(len(items.names)), "at": np.array(items.names, dtype=np.int64)}))
    return found.join(F.broadcast(places), "item").select(F.col("at").alias("item"), "rank", "key", "score")


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, key, score``: for each row of ``items`` its TOP documents.

    Documents without words, and those that share no word with an item, are not ranked;
    equal scores rank by ascending ``key``, null keys last. Items without words (null,
    empty) have no rows; rows that repeat an item are ranked each. ``key`` is an integer;
    repeated keys are documents of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    configure(spark)
    passes = max(1, -(-items.count() // ITEMS))
    schema = items.select(F.col(item).alias(item)).schema
    out = spark.createDataFrame([], schema.add("rank", "integer").add(key, "long").add("score", "long"))
    of_pass = F.pmod(F.xxhash64(F.col(item), F.col(item_text)), F.lit(passes))
    for number in range(passes):
        # About ITEMS rows; the documents are read once for them.
        rows = [tuple(r) for r in items.filter(of_pass == number).select(item, item_text).collect()]
        found = search_slice(docs, rows, key, text)
        if found is None:
            continue
        names = [(i, name) for i, (name, _) in enumerate(rows)]
        named = spark.createDataFrame(names, T.StructType().add("item", "long").add("name", items.schema[item].dataType))
        part = found.join(F.broadcast(named), "item").select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")
        out = out.unionByName(part)
    return out

