"""Alignment against the libraries and a plain count of all links."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dissensus.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(align.tokenfiles.byte_letters())}
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def groups_of(text, a, b, bytes_a, bytes_b):
    """Groups of ids of both sides, one token after the other."""
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(map(bytes_a, x)) == b"".join(map(bytes_b, y)) == (" " + text).encode():
        return []
    out, end_x, end_y = [([], [])], 0, 0
    while x or y:
        if end_x == end_y and out[-1][0]:
            out.append(([], []))
        if end_x <= end_y:
            end_x += len(bytes_a(x[0]))
            out[-1][0].append(x.pop(0))
        else:
            end_y += len(bytes_b(y[0]))
            out[-1][1].append(y.pop(0))
        if end_x < end_y or not y:
            continue
        while end_y < end_x and y:
            end_y += len(bytes_b(y[0]))
            out[-1][1].append(y.pop(0))
    return out


def expected(rows):
    library = libraries()
    made = [(key, groups_of(text, *library)) for key, text in rows]
    links = [collections.Counter((x, y) for p, q in groups for x in p for y in q) for _, groups in made]
    held = collections.Counter(pair for found in links for pair in found)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for (key, groups), found in zip(made, links):
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append(
            (key, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(found.values()),
             sum(n for pair, n in found.items() if held[pair] == best[pair[0]]), sum(n * held[pair] for pair, n in found.items()),
             hashlib.sha256(written.encode()).hexdigest() if groups else "")
        )
    return out


def found(docs):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = align.align(docs, A, B).collect()
    assert not rows or list(rows[0].asDict()) == names
    return sorted((tuple(r) for r in rows), key=str)


def odd_texts(n):
    rng = random.Random(3)
    parts = ["the ", "rain", " in", "  ", "\n", "\t", "é", "中文", "😀", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "1234", "don't", "a" * 30, "\x00", " ", "...", "́"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("shared", [0, 40, align.SHARED_PAIRS])
def test_alignments_against_the_libraries(spark, monkeypatch, shared):
    # Without room for shared pairs all irregular ones are joined.
    monkeypatch.setattr(align, "SHARED_PAIRS", shared)
    texts = [None, "", " ", "  ", "a", "a", "sp ▁ ace", "▁", "long " * 3000, "ab" * 4000, " lead", "trail "] + odd_texts(300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no key"), (4, "a"), (4, "rain in the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS key", "2 AS n_a", "3 AS pairs").repartition(3)
    assert found(docs) == sorted(expected(rows), key=str)


def test_large_groups_are_counted_by_id(spark, monkeypatch):
    monkeypatch.setattr(align, "GROUP_LINKS", 3)
    rows = list(enumerate(["ab" * 4000, "中文字" * 50, *odd_texts(60)]))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(expected(rows), key=str)


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == sorted(expected(rows), key=str)


def test_tasks_give_out_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(align, "KEPT_PAIRS", 50)
    rows = list(enumerate(odd_texts(120)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(expected(rows), key=str)


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
