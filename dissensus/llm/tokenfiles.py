"""Token ids of a corpus in compressed files, each a wavelet matrix.

A file holds the ids of consecutive documents as one bit-plane per bit of the largest
id. Plane by plane, from the highest bit, ids whose bit is 0 move in front of those whose
bit is 1, in unchanged order. With running counts of ones, single ids, counts and places
of an id are found without unpacking the others.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissensus.llm import files, pretokens
from dissensus.session import scratch_folder, written

MAGIC = b"WVMX0001"
END_ID = 0
# Ids after which a file is closed at the end of a document; bounds a task's memory.
FILE_IDS = 1 << 22
BLOCK = 512  # bits between two stored counts of ones
# Numbers that are moved at once: they and their places stay in a core's cache.
MOVED = 1 << 15


def sides(high: np.ndarray):
    """Slice by slice of a plane: where it begins, and the places in it of zeros and ones."""
    for at in range(0, len(high), MOVED):
        some = high[at : at + MOVED]
        yield at, np.flatnonzero(~some), np.flatnonzero(some)


@dataclass
class WaveletMatrix:
    """Bit-planes of ``size`` numbers, from the highest bit, as 64-bit words."""

    size: int
    planes: list[np.ndarray]  # uint64 words, bit i of the plane is bit i % 64 of word i // 64
    ones: list[np.ndarray]  # ones before each block
    zeros: list[int]

    @classmethod
    def of(cls, values: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        bits = bits or max(1, int(values.max()).bit_length() if len(values) else 1)
        planes, ones, zeros = [], [], []
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        padded = -(-max(1, len(values)) // BLOCK) * BLOCK
        for bit in reversed(range(bits)):
            high = now & now.dtype.type(1 << bit) != 0
            packed = np.packbits(high, bitorder="little")
            plane = np.zeros(padded // 8, dtype=np.uint8)
            plane[: len(packed)] = packed
            plane = plane.view(np.uint64)
            count = np.bitwise_count(plane).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            planes.append(plane)
            ones.append(np.concatenate([[0], np.cumsum(count)]).astype(np.uint32))
            zeros.append(int(len(now) - count.sum()))
            moved, low, up = np.empty_like(now), 0, zeros[-1]
            for at, down, over in sides(high):
                some = now[at : at + MOVED]
                moved[low : low + len(down)] = some[down]
                moved[up : up + len(over)] = some[over]
                low, up = low + len(down), up + len(over)
            now = moved
        return cls(len(values), planes, ones, zeros)

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before the positions ``at``."""
        at = np.asarray(at, dtype=np.int64)
        plane, block = self.planes[level], at // BLOCK
        count = self.ones[level][block].astype(np.int64)
        word = block * (BLOCK // 64)
        for _ in range(BLOCK // 64):
            left = np.clip(at - word * 64, 0, 64)
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            inside = np.minimum(word, len(plane) - 1)
            count += np.where(left > 0, np.bitwise_count(plane[inside] & mask), 0)
            word = word + 1
        return count

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the positions ``at``."""
        at, out = np.asarray(at, dtype=np.int64).copy(), np.zeros(len(at), dtype=np.int64)
        for level in range(len(self.planes)):
            bit = (self.planes[level][at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            before = self.rank(level, at)
            out = out * 2 + bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[level] + before, at - before)
        return out

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of a number before ``upto`` stand below the last plane."""
        ends = np.array([0, upto], dtype=np.int64)
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            before = self.rank(level, ends)
            one = value >> (len(self.planes) - 1 - level) & 1
            ends = self.zeros[level] + before if one else ends - before
        return int(ends[0]), int(ends[1])

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of a number before a position, by default in all."""
        lo, hi = self._range(value, self.size if upto is None else upto)
        return hi - lo

    def select(self, value: int, which: np.ndarray) -> np.ndarray:
        """Positions of the occurrences ``which`` (from 0) of a number."""
        lo, hi = self._range(value, self.size)
        which = np.asarray(which, dtype=np.int64)
        if len(which) and (which.min() < 0 or which.max() >= hi - lo):
            raise IndexError("no such occurrence")
        at = lo + which
        for level in reversed(range(len(self.planes))):
            high = self._bits(level)
            one = value >> (len(self.planes) - 1 - level) & 1
            at = np.flatnonzero(high)[at - self.zeros[level]] if one else np.flatnonzero(~high)[at]
        return at

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), count=self.size, bitorder="little").astype(bool)

    def values(self) -> np.ndarray:
        """All numbers, by undoing the moves from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.size, dtype=kind)
        for level in reversed(range(len(self.planes))):
            above, low, up = np.empty_like(now), 0, self.zeros[level]
            now[up:] |= kind(1 << (len(self.planes) - 1 - level))
            for at, down, over in sides(self._bits(level)):
                some = above[at : at + MOVED]
                some[down] = now[low : low + len(down)]
                some[over] = now[up : up + len(over)]
                low, up = low + len(down), up + len(over)
            now = above
        return now


@dataclass
class TokenFile:
    """A wavelet matrix and the documents whose ids it holds, one after another."""

    keys: np.ndarray  # int64; meaningless where ``known`` is false
    known: np.ndarray
    lengths: np.ndarray
    matrix: WaveletMatrix

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        parts = [self.keys.astype("<i8"), self.known.astype("u1"), self.lengths.astype("<i8")]
        parts += [p.astype("<u8") for p in self.matrix.planes] + [o.astype("<u4") for o in self.matrix.ones]
        packed = [press(p.tobytes()) for p in parts]
        head = {"size": self.matrix.size, "zeros": self.matrix.zeros, "parts": list(map(len, packed))}
        head = json.dumps(head).encode()
        body = struct.pack("<I", len(head)) + head + b"".join(packed)
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> "TokenFile":
        if data[:8] != MAGIC or struct.unpack("<I", data[8:12])[0] != zlib.crc32(data[12:]):
            raise ValueError("not a whole token file")
        (size,) = struct.unpack("<I", data[12:16])
        head, at, parts = json.loads(data[16 : 16 + size]), 16 + size, []
        for length in head["parts"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + length]))
            at += length
        n = len(head["zeros"])
        planes = [np.frombuffer(p, "<u8") for p in parts[3 : 3 + n]]
        ones = [np.frombuffer(p, "<u4") for p in parts[3 + n :]]
        keys, known, lengths = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "u1", "<i8")))
        return cls(keys, known.astype(bool), lengths, WaveletMatrix(head["size"], planes, ones, head["zeros"]))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: the byte's own
    if it shows in Latin-1, else the next unused one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@functools.cache
def marked(path: str):
    """A function that gives, for each of some texts, the library's own ids if the text
    holds an added token of the vocabulary file (such as ``<|endoftext|>``), else None."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    contents = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(texts: list[str]) -> list[list[int] | None]:
        return [tokenizer.encode(t, add_special_tokens=False).ids if any(c in t for c in contents) else None for t in texts]

    return ids


def spliced(coded: pretokens.Coded, own: list[list[int] | None]) -> pretokens.Coded:
    """``coded`` with other ids for the texts that have some in ``own``."""
    if not any(o is not None for o in own):
        return coded
    parts = [coded.ids[a:b] if o is None else np.array(o, coded.ids.dtype) for o, a, b in zip(own, coded.bounds[:-1], coded.bounds[1:])]
    return pretokens.Coded(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


@functools.cache
def coder(path: str) -> tuple[pretokens.Memo, int]:
    """The tokenizers library's merges of a byte-level vocabulary file, and its size."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, dict(enumerate(byte_letters()))

    blank = letters[32]

    def spelled(p: str) -> str:
        # Of the printable ASCII signs, only a blank has another letter.
        return p.replace(" ", blank) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters)

    def encode(pieces: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(spelled(p))] for p in pieces]

    return pretokens.Memo(encode), tokenizer.get_vocab_size()


def write(
    docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, file_ids: int = FILE_IDS, added: bool = False,
) -> DataFrame:
    """Write the ids of all texts, in ascending order of ``key``, to files in ``folder``.

    Returns the list of files in their order: ``file, part, place, n_docs, n_ids``. Each
    document is followed by ``end_id``; null and empty texts have that id only. Null keys
    come first, equal keys in an order their texts set. An empty table gives no files.
    The texts are range-partitioned by key and a hash of the text, so that a key that many rows share
    is split too; a file holds whole documents of one partition.

    ``added``: the vocabulary's added tokens in a text become their ids, as the library
    does by default; else they are text like any other (its ``encode_special_tokens``).
    """
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Splitters go through the driver: a hash stands for the text there.
    ranged = source.withColumn("mark", F.xxhash64("text")).repartitionByRange("key", "mark")
    ordered = ranged.sortWithinPartitions("key", "mark", "text").drop("mark")
    schema = "file string, part int, place int, n_docs long, n_ids long"

    def run(batches):
        memo, vocabulary = coder(path)
        bits = int(max(vocabulary - 1, end_id)).bit_length()
        part, place = TaskContext.get().partitionId(), 0
        keys, ids, lengths = [], [], []

        def close():
            known = [k.is_valid().to_numpy(zero_copy_only=False) for k in keys]
            values = [k.fill_null(0).to_numpy(zero_copy_only=False) for k in keys]
            size = np.concatenate(lengths)
            matrix = WaveletMatrix.of(np.concatenate(ids), bits)
            name = f"tokens-{part:07d}-{place:05d}.wvm"
            files.put(folder, name, TokenFile(np.concatenate(values), np.concatenate(known), size, matrix).to_bytes())
            return pa.RecordBatch.from_pydict(
                {"file": [name], "part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()),
                 "n_docs": [len(size)], "n_ids": [matrix.size]}
            )

        for batch in batches:
            for lo, hi, texts in pretokens.blocks(batch, "text"):
                coded = memo.texts(texts)
                if added:
                    coded = spliced(coded, marked(path)(texts))
                keys.append(batch.column("key").slice(lo, hi - lo))
                # The end id goes in after each document.
                ids.append(np.insert(coded.ids.astype(np.uint32), coded.bounds[1:], end_id))
                lengths.append(np.diff(coded.bounds) + 1)
                if sum(map(len, ids)) >= file_ids:
                    yield close()
                    place += 1
                    keys, ids, lengths = [], [], []
        if keys:
            yield close()

    return written(ordered.mapInArrow(run, schema), "token-file-list")


def read(listed: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of the files in a list of ``write``: ``key, file, at, n_tokens, ids_crc32``.

    ``at`` is the place of the document's first id within its file. The ids come out of
    the bit-planes; ``ids_crc32`` is over them as little-endian unsigned 32-bit integers.
    """
    spark = listed.sparkSession
    schema = f"`{key}` long, file string, at long, n_tokens long, ids_crc32 long"
    if listed.isEmpty():
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = TokenFile.from_bytes(batch.column("content")[i].as_buffer().to_pybytes())
                ids = held.matrix.values().astype("<u4")
                ends = np.cumsum(held.lengths)
                at = ends - held.lengths
                sums = [zlib.crc32(ids[a:b].data) for a, b in zip(at.tolist(), ends.tolist())]
                name = batch.column("path")[i].as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.keys, mask=~held.known), pa.array([name] * len(at)), pa.array(at), pa.array(held.lengths), pa.array(sums, pa.int64())],
                    names=[key, "file", "at", "n_tokens", "ids_crc32"],
                )

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    return stored.mapInArrow(run, schema)


def corpus(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Write token files of a corpus to the shared folder and describe its documents.

    Returns ``key, start, n_tokens, ids_crc32, file``; ``start`` is the number of ids of
    all documents before this one. ``added`` is that of ``write``.
    """
    folder = scratch_folder(docs.sparkSession, "token-files")
    listed = write(docs, path, folder, key, text, added=added)
    # One row per file, not per document: the running sum stays small.
    order = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    begins = listed.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("begin"))
    return (
        read(listed, folder, key)
        .join(begins, "file")
        .select(key, (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file")
    )
