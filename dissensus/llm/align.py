"""Alignment of the tokens of two tokenizers over the same bytes.

Places where tokens of both end cut a text into groups, and all tokens of a group are
linked. Most groups hold one token of each side with the same bytes; an array made once
from the vocabularies names that partner (the identity map), so such links are kept as one
id and counted in vectors as long as the vocabulary. Only links of other pairs are counted
by a shuffle. The pairs that most documents hold go back to the documents in an array of
bounded size, the others in a join.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissensus.llm import pretokens, tokenfiles
from dissensus.llm import words as W
from dissensus.session import configure, written

# Pairs that go to all tasks in an array of 16 bytes each; the others are joined.
SHARED_PAIRS = 1 << 19
# Classes of counts to the power of two, from which the shared pairs are chosen.
COUNT_CLASSES = 8
# Distinct pairs a task counts before it gives them out.
KEPT_PAIRS = 1 << 20
# Links of one group that are written out one by one; larger groups are counted by id.
GROUP_LINKS = 1 << 12


class Vocabulary:
    """The bytes of all tokens: those of id i are ``data[first[i]:first[i + 1]]``."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.tokens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - ends + size, size)]


@functools.cache
def byte_side(path: str) -> tuple[pretokens.Memo, Vocabulary]:
    """Encoder and bytes of a byte-level vocabulary file of the tokenizers library;
    strings of its special tokens are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in enumerate(tokenfiles.byte_letters())}
    tokens = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        tokens[i] = bytes(byte_of[c] for c in token)
    return tokenfiles.coder(path)[0], Vocabulary(tokens)


@functools.cache
def piece_side(path: str) -> tuple[pretokens.Memo, Vocabulary]:
    """Encoder and bytes of a sentencepiece model file that adds a space to a text.

    No piece goes on after a space that follows another character, so the model merges
    nothing across such a border, and the parts between them are encoded by themselves.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens, crossing = [], False
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[1:-1], 16)]))
        else:
            crossing |= "\u2581" in piece.lstrip("\u2581")
            tokens.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("\u2581", " ").encode())
    blank = [model.piece_to_id("\u2581")]

    def encode(parts: list[str]) -> list[list[int]]:
        # Each part begins with the space that the model would add.
        found = model.encode([p[1:] for p in parts], num_threads=1)
        return [ids if len(p) > 1 else blank for p, ids in zip(parts, found)]

    whole = lambda cp, bounds: bounds[:-1][np.diff(bounds) > 0]
    return pretokens.Memo(encode, starts=whole if crossing else pretokens.space_starts), Vocabulary(tokens)


def identity_map(a: Vocabulary, b: Vocabulary) -> np.ndarray:
    """For each id of a the id of b with the same bytes, else -1. Of several ids of b, the
    last: pieces come after the single bytes they may equal."""
    of = {t: i for i, t in enumerate(b.tokens) if t}
    return np.array([of.get(t, -1) for t in a.tokens], dtype=np.int64)


def separated(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by its mark, as one array of bytes, and their ends."""
    digits = np.searchsorted(10 ** np.arange(1, 10), ids, side="right") + 1
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[ends - 1] = marks
    left = ids.copy()
    for place in range(int(digits.max()) if len(digits) else 0):
        on = digits > place
        out[ends[on] - 2 - place] = 48 + left[on] % 10
        left //= 10
    return out, ends


@dataclass
class Aligned:
    """Alignment of some texts; arrays with one number per text, and the distinct linked
    pairs of each text with their numbers of links: identity pairs as an id of a in
    ``same``, others as ``a * (ids of b) + b`` in ``pairs``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    same: tuple[np.ndarray, np.ndarray, np.ndarray]  # bounds per text, ids, links
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(rows: np.ndarray, values: np.ndarray, many: np.ndarray, n: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) with the sums of ``many``: bounds per row, values, sums."""
    key, at = np.unique(rows * top + values, return_inverse=True)
    sums = np.zeros(len(key), dtype=np.int64)
    np.add.at(sums, at, many)
    return np.searchsorted(key, np.arange(n + 1) * top), key % top, sums


def aligned(texts: list[str], side_a, side_b, identity: np.ndarray) -> Aligned:
    """``texts`` hold no null. A text that is empty, or whose tokens of either side do not
    join to a space and the text, has no tokens."""
    (memo_a, voc_a), (memo_b, voc_b) = side_a, side_b
    n = len(texts)
    spaced = [" " + t if t else "" for t in texts]
    data, offsets = W.utf8(pa.array(spaced, pa.string()))
    coded = [(memo.texts(spaced), voc) for memo, voc in ((memo_a, voc_a), (memo_b, voc_b))]
    fits = np.diff(offsets) > 0
    for c, voc in coded:
        bytes_to = np.concatenate([[0], np.cumsum(voc.lengths[c.ids])])[c.bounds]
        fits &= np.diff(bytes_to) == np.diff(offsets)
        joined = voc.joined(c.ids)
        if len(joined) == len(data) and (bytes_to == offsets).all():
            odd = np.flatnonzero(joined != data)
            fits[np.searchsorted(offsets, odd, side="right") - 1] = False
        else:
            for i in np.flatnonzero(fits):
                fits[i] = np.array_equal(joined[bytes_to[i] : bytes_to[i + 1]], data[offsets[i] : offsets[i + 1]])
    ids, ends, rows, counts = [], [], [], []
    for c, voc in coded:
        count = np.diff(c.bounds)
        kept = np.repeat(fits, count)
        ids.append(c.ids[kept].astype(np.int64))
        ends.append(np.cumsum(voc.lengths[ids[-1]]))
        counts.append(np.where(fits, count, 0))
        rows.append(np.repeat(np.arange(n), counts[-1]))
    (a, b), (end_a, end_b) = ids, ends
    cuts = end_a[np.isin(end_a, end_b, assume_unique=True)]
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    g = len(cuts)
    of_a, of_b = np.bincount(group_a, minlength=g), np.bincount(group_b, minlength=g)
    first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    row = rows[0][first_a] if g else np.zeros(0, np.int64)
    links = of_a * of_b
    per_row = lambda x: np.bincount(row, x, minlength=n).astype(np.int64)
    # Links of groups of one token each that the identity map knows.
    plain = links == 1
    plain[plain] = identity[a[first_a[plain]]] == b[first_b[plain]]
    same = [(row[plain], a[first_a[plain]], np.ones(int(plain.sum()), np.int64))]
    # Links of other groups of a usual size, one by one.
    usual = np.flatnonzero(~plain & (links <= GROUP_LINKS))
    size = links[usual]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(of_b[usual], size)
    x, y = a[np.repeat(first_a[usual], size) + inside // wide], b[np.repeat(first_b[usual], size) + inside % wide]
    found = [(np.repeat(row[usual], size), x, y, np.ones(len(x), np.int64))]
    for at in np.flatnonzero(links > GROUP_LINKS):
        # Links of equal ids in a large group are counted together.
        x, of_x = np.unique(a[first_a[at] : first_a[at] + of_a[at]], return_counts=True)
        y, of_y = np.unique(b[first_b[at] : first_b[at] + of_b[at]], return_counts=True)
        found.append((np.full(len(x) * len(y), row[at]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(of_x, of_y).ravel()))
    of_row, x, y, many = (np.concatenate(part) for part in zip(*found))
    known = identity[x] == y
    same.append((of_row[known], x[known], many[known]))
    of_row, x, y, many = (v[~known] for v in (of_row, x, y, many))
    # The ids of all groups in writing.
    merged = np.empty(len(a) + len(b), dtype=np.int64)
    marks = np.empty(len(merged), dtype=np.uint8)
    at_a, at_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + (first_a + of_a)[group_b]
    merged[at_a], merged[at_b] = a, b
    last_a, last_b = np.isin(end_a, cuts, assume_unique=True), np.isin(end_b, cuts, assume_unique=True)
    marks[at_a], marks[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    text, text_ends = separated(merged, marks)
    upto = np.concatenate([[0], text_ends])[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])]
    digests = [hashlib.sha256(text[i : j - 1].data).hexdigest() if j > i else "" for i, j in zip(upto[:-1].tolist(), upto[1:].tolist())]
    return Aligned(
        counts[0], counts[1], np.bincount(row, minlength=n), per_row(links), digests,
        summed(*(np.concatenate(part) for part in zip(*same)), n, len(voc_a)),
        summed(of_row, x * len(voc_b) + y, many, n, len(voc_a) * len(voc_b)),
    )


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``row, key, n_a, n_b, n_groups, n_links, groups_sha256`` and
    its linked pairs as ``same, same_links, pairs, pair_links`` (see ``Aligned``). ``row``
    tells rows apart that repeat a key."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = source.select("row", "key").schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    for name in ("same", "same_links", "pairs", "pair_links"):
        schema = schema.add(name, T.ArrayType(T.LongType(), False))

    def run(batches):
        side_a, side_b = byte_side(path_a), piece_side(path_b)
        identity = identity_map(side_a[1], side_b[1])
        for batch in batches:
            for lo, hi, texts in pretokens.blocks(batch, "text", 1 << 19):
                found = aligned(texts, side_a, side_b, identity)
                lists = []
                for bounds, *values in (found.same, found.pairs):
                    lists += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(v)) for v in values]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo),
                     *map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(found.digests), *lists],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def identity_counts(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold the identity pair of each id of a."""

    def run(batches):
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = batch.column("same").flatten().to_numpy()
            counts += np.bincount(ids, minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["a", "n"])

    summed_up = found.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)  # as many numbers as the vocabulary has ids
    out[summed_up.column("a").to_numpy()] = summed_up.column("n").to_numpy()
    return out


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, n``: how many documents hold each linked pair that is no identity pair.
    Tasks count their documents' pairs before they are shuffled."""

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, size = [], 0

        def merged():
            every = np.concatenate([keys, *waiting])
            many = np.concatenate([counts, *[np.ones(len(w), np.int64) for w in waiting]])
            distinct, at = np.unique(every, return_inverse=True)
            return distinct, np.bincount(at, many, minlength=len(distinct)).astype(np.int64)

        def given():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy()
            for lo in range(0, len(pairs), KEPT_PAIRS):
                waiting.append(pairs[lo : lo + KEPT_PAIRS])
                size += len(waiting[-1])
                if size >= KEPT_PAIRS:
                    (keys, counts), waiting, size = merged(), [], 0
                    if len(keys) >= KEPT_PAIRS:
                        yield given()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield given()

    return found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``.

    Both sides encode a space and the text, without special tokens: ``path_a`` is a
    byte-level vocabulary file of the tokenizers library, ``path_b`` a sentencepiece model
    (which adds the space). ``n_links`` counts the pairs of tokens in the same group;
    ``count_sum`` sums over them in how many documents their two ids are linked, and
    ``n_best`` counts those for which that number is the highest of their a id.
    Texts that are null, empty or not given back by a tokenizer have zeros and an empty
    digest. Null and repeated keys are rows like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    configure(spark)
    found = written(alignments(docs, path_a, path_b, key, text), "alignments")
    a, b = byte_side(path_a)[1], piece_side(path_b)[1]
    n_b = len(b)
    identity = identity_counts(found, len(a))
    counts = written(pair_counts(found), "pair-counts").withColumn("class", F.floor(F.log2("n") * COUNT_CLASSES))
    best = identity.copy()
    # At most one row per id of a.
    highest = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("n")).toArrow()
    ids = highest.column("a").to_numpy()
    best[ids] = np.maximum(best[ids], highest.column("n").to_numpy())
    # As many classes of the highest counts as SHARED_PAIRS has room for.
    least, room = 1 << 30, SHARED_PAIRS
    for count_class, n in sorted(counts.groupBy("class").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = count_class
    often = counts.filter(F.col("class") >= least).select("pair", "n").orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((identity, best, often.column("pair").to_numpy(), often.column("n").to_numpy()))
    kept = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = found.select(*kept).schema.add("n_best", "long").add("count_sum", "long")
    for name in ("pairs", "pair_links"):
        schema = schema.add(name, T.ArrayType(T.LongType(), False))

    def run(batches):
        identity, best, keys, numbers = shared.value
        for batch in batches:
            n = batch.num_rows
            flat = lambda c: batch.column(c).flatten().to_numpy()
            row_of = lambda c: np.repeat(np.arange(n), batch.column(c).value_lengths().to_numpy())
            same, same_links, pairs, links = (flat(c) for c in ("same", "same_links", "pairs", "pair_links"))
            row, row_same = row_of("pairs"), row_of("same")
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            count = numbers[at[known]]
            top, top_same = count == best[pairs[known] // n_b], identity[same] == best[same]
            total, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, row_same, same_links * identity[same])
            np.add.at(total, row[known], links[known] * count)
            np.add.at(n_best, row_same[top_same], same_links[top_same])
            np.add.at(n_best, row[known][top], links[known][top])
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=n))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v[~known])) for v in (pairs, links)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n_best), pa.array(total), *lists], names=schema.names)

    scored = written(found.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("link"))
    rare = rare.select("row", F.col("link.pairs").alias("pair"), F.col("link.pair_links").alias("links"))
    # One row per id of a.
    tops = F.broadcast(spark.createDataFrame(pa.table({"a": np.arange(len(best)), "best": best})))
    others = counts.filter(F.col("class") < least).withColumn("a", F.expr(f"pair div {n_b}")).join(tops, "a")
    others = others.select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    added = rare.join(others, "pair").groupBy("row").agg(
        F.sum(F.col("links") * F.col("n")).alias("more"), F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("more_best")
    )
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return scored.join(added, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256"
    )
