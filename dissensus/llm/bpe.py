"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one last token of its encoding, so one
table row per byte holds all encodings at once: the row of a prefix of length i names
the token that ends it, and the row i minus that token's length goes on backwards. A
token may follow another if the two, encoded together, stay apart. Rows depend on the
bytes before them only: an append adds rows, and an edit needs new rows from the edit on
until the rows agree with the old ones for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissensus.llm import pretokens

NEVER = 1 << 40
# Pairs of tokens a worker remembers.
KEPT_PAIRS = 1_000_000


class Ranks:
    """A vocabulary of byte strings whose id is the rank of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.text = [str(i) for i in range(size)]
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tails = {t[i:]: -1 for t in ranks for i in range(len(t))} | ranks
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    @classmethod
    @functools.cache
    def load(cls, path: str) -> "Ranks":
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition: merge the neighbours of the lowest rank, leftmost first, down to ``stop`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER)
        open_ = [rank(i) for i in range(len(parts) - 1)]
        while len(parts) > stop and (least := min(open_)) < NEVER:
            i = open_.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del open_[i]
            for k in (i - 1, i):
                if 0 <= k < len(open_):
                    open_[k] = rank(k)
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token: itself twice for a byte, None if
        merges never make it; then only a piece that equals it has it."""
        if token not in self.halves:
            data = self.bytes[token]
            parts = self.merge(data, 2)
            made = len(parts) == 2 and all(p in self.ranks for p in parts)
            made = made and all(len(p) == 1 or self.split(self.ranks[p]) for p in parts)
            self.halves[token] = (token, token) if len(data) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if made else None
        return self.halves[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge joins them across their border.

        Undoes the merges on both sides of the border, the latest first. A merge across
        it wins if it comes before those that use up its two sides.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, x_used, y_used = a, b, NEVER, NEVER
        known = True
        while True:
            across = self.ranks.get(self.bytes[x] + self.bytes[y], NEVER)
            if across < x_used and across <= y_used and across < NEVER:
                known = False
                break
            x_byte, y_byte = len(self.bytes[x]) == 1, len(self.bytes[y]) == 1
            if x_byte and y_byte:
                break
            if y_byte or not x_byte and x > y:
                x, x_used = self.split(x)[1], x
            else:
                y, y_used = self.split(y)[0], y
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = known
        return known

    def rows(self, data: bytes, last: list[int], upto: int) -> None:
        """Add the rows of the prefixes len(last) .. upto to ``last`` (last[0] is unused)."""
        tails, pairs = self.tails, self.pairs
        for end in range(len(last), upto + 1):
            for begin in range(end - 1, -1, -1):
                token = tails.get(data[begin:end])
                if token is None:  # no token ends like this
                    raise ValueError(f"no token ends {data[max(0, end - 20):end]!r}")
                if token < 0 or not self.split(token):
                    continue
                if not begin or (pairs.get((last[begin], token)) is not False and self.apart(last[begin], token)):
                    last.append(token)
                    break

    def path(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pieces; in sorted order, a piece takes over its neighbour's rows."""
        out: list[list[int]] = [[]] * len(pieces)
        before, last = b"", [-1]
        for i in sorted(range(len(pieces)), key=pieces.__getitem__):
            data = pieces[i]
            whole = self.ranks.get(data)
            if whole is not None:
                out[i] = [whole]
                continue
            same = 0
            for x, y in zip(data, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            self.rows(data, last, len(data))
            before, out[i] = data, self.path(last)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - ends + size, size)
        return self.data[take].tobytes()


class Prefixes:
    """The encoding of one growing or edited byte string, without a split into pieces."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.ranks.rows(self.data, self.last, len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns the number of rows worked out again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same, done = 0, 0
        after = start + len(new)
        for row in range(start + 1, len(self.data) + 1):
            self.ranks.rows(self.data, self.last, row)
            done += 1
            same = same + 1 if row > after and self.last[row] == old[row - shift] else 0
            if same >= self.ranks.longest:
                self.last += old[row - shift + 1 :]
                break
        return done

    def ids(self, upto: int | None = None) -> list[int]:
        """Ids of the first ``upto`` bytes, by default of all."""
        return self.ranks.path(self.last[: (len(self.data) if upto is None else upto) + 1])


@functools.cache
def memo(path: str) -> pretokens.Memo:
    ranks = Ranks.load(path)
    return pretokens.Memo(lambda pieces: ranks.pieces([p.encode() for p in pieces]))


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``array<int>`` in the column ``name``.

    Null and empty texts have no ids. Other columns stay as they are; one called
    ``name`` is replaced. ``path`` is a file of base64 tokens and ranks that every
    executor can read.
    """
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, T.ArrayType(T.IntegerType()))

    def run(batches):
        coder = memo(path)
        for batch in batches:
            for lo, hi, texts in pretokens.blocks(batch, text):
                coded = coder.texts(texts)
                ids = pa.ListArray.from_arrays(pa.array(coded.bounds.astype(np.int32)), pa.array(coded.ids.astype(np.int32)))
                columns = [batch.column(c).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, ids], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``coded`` with the bytes of ``ids`` in the column ``name``; null ids are no bytes."""
    kept = [c for c in coded.columns if c != name]
    schema = coded.select(*kept).schema.add(name, "binary")

    def run(batches):
        ranks = Ranks.load(path)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                values = row.column(ids)[0].values
                found = ranks.decode(values.to_numpy(zero_copy_only=False)) if values is not None else b""
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in kept], pa.array([found], pa.binary())], names=[*kept, name])

    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, one row per document.

    The same as ``encode`` and ``decode`` followed by hashes, in one pass over the rows:
    ids and bytes of a block of texts are dropped once they are hashed. Null and empty
    texts have zero ids; a null ``key`` stays null; repeated rows are all returned.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = source.select("key").schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        ranks, coder = Ranks.load(path), memo(path)
        word = ranks.text.__getitem__
        for batch in batches:
            for lo, hi, texts in pretokens.blocks(batch, "text"):
                coded = coder.texts(texts)
                bounds = coded.bounds.tolist()
                ids, decoded = [], []
                for a, b in zip(bounds, bounds[1:]):
                    part = coded.ids[a:b]
                    ids.append(hashlib.sha256(",".join(map(word, part.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(ranks.decode(part)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, hi - lo), pa.array(np.diff(coded.bounds)), pa.array(ids), pa.array(decoded)],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def exact(texts: Column, decoded: Column) -> Column:
    """Whether decoded bytes are the text they came from (null: the empty text)."""
    return F.encode(F.coalesce(texts, F.lit("")), "UTF-8") == decoded
