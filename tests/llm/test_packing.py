"""Packing: pieces against the library, places against the rules of a sequence."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dissensus.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces(rows, size=2048):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            out.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(found, rows, size=2048):
    assert sorted((tuple(r)[:5] for r in found), key=str) == pieces(rows, size)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


def test_pieces_and_places(spark):
    rng = random.Random(2)
    parts = ["the ", "Rain", " in", "  ", "\n", " ", "é", "é", "Σς ", "中文", "😀", "<|endoftext|>", "<|startoftext|> ", "1234", "don't", "X" * 40, "...", "\x1c", "İ"]
    texts = [None, "", " ", "Long words " * 3000, "a " * 2047, "a " * 2048, *["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(400)]]
    rows = [*enumerate(texts), (None, "no key"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "'x' AS key", "2 AS length", "3 AS task").repartition(5)
    found = packing.pack(docs, PATH).collect()
    total = sum(r["length"] for r in found)
    assert check(found, rows) <= total / 2048 + 2
    assert check(packing.pack(docs, PATH, size=7).collect(), rows, 7) <= total / 7 * 1.05


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = packing.pack(docs, PATH).collect()
    assert check(found, rows) <= sum(r["length"] for r in found) / 2048 * 1.02 + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def fewest(lengths, size):
    """The fewest sequences, by trying all."""
    best = len(lengths)

    def go(at, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if at == len(lengths):
            best = len(gaps)
            return
        for gap in sorted({g for g in gaps if g >= lengths[at]}):
            i = gaps.index(gap)
            go(at + 1, gaps[:i] + [gap - lengths[at]] + gaps[i + 1 :])
        go(at + 1, [*gaps, size - lengths[at]])

    go(0, [])
    return best


def test_nearly_as_few_sequences_as_possible():
    rng, more = random.Random(5), 0
    for _ in range(60):
        size = rng.choice([10, 24])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 10))), reverse=True)
        made = packing.packed(np.bincount(lengths, minlength=size + 1))
        held = sorted(itertools.chain.from_iterable(p * n for p, n in made), reverse=True)
        assert held == lengths and all(sum(p) <= size for p, _ in made)
        more += sum(n for _, n in made) - fewest(lengths, size)
    assert 0 <= more <= 3


@pytest.mark.parametrize("top", [2048, 900, 130])
def test_many_pieces_fill_their_sequences(top):
    rng = np.random.default_rng(top)
    histogram = np.bincount(rng.integers(1, top + 1, 40_000), minlength=2049)
    made = packing.packed(histogram)
    back = np.zeros(2049, dtype=np.int64)
    for pattern, times in made:
        assert sum(pattern) <= 2048 and times > 0
        np.add.at(back, np.array(pattern), times)
    assert (back == histogram).all()
    assert sum(n for _, n in made) <= (histogram * np.arange(2049)).sum() / 2048 * 1.01 + 1


def test_least_squares_against_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.random((8, 20)), rng.normal(size=8)
        x = packing.non_negative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[x > 0]).max(initial=0) < 1e-6
