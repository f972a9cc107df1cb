"""Encoding against the library, decoding against the texts."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from dissensus.llm import bpe
from tests.llm.test_text import thue_morse

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_like_the_library(library):
    rng, ranks = random.Random(5), bpe.Ranks.load(PATH)
    made = {"".join(rng.choices("aeinrsthé中😀Т1!", k=rng.randint(1, 40))) for _ in range(3000)} | {"x" * 3000, "ab" * 900}
    made = sorted(made)
    for text, ids in zip(made, ranks.pieces([t.encode() for t in made])):
        assert ids == library._encode_single_piece(text), text


def test_unmergeable_token_only_for_a_whole_piece():
    # "abc" has a rank, but no merges make it: a, b and c never meet in a pair.
    ranks = bpe.Ranks({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})
    assert ranks.pieces([b"abc", b"abca", b"ca"]) == [[3], [0, 1, 2, 0], [2, 0]]


def test_append_and_edit():
    rng, ranks = random.Random(6), bpe.Ranks.load(PATH)
    merged = lambda data: [ranks.ranks[p] for p in ranks.merge(data)]
    for _ in range(60):
        data = "".join(rng.choices("thein ras", k=rng.randint(0, 300))).encode()
        held = bpe.Prefixes(ranks, data)
        assert held.ids() == merged(data)
        cut = rng.randint(0, len(data))
        assert held.ids(cut) == merged(data[:cut])
        held.append(b" then")
        start = rng.randint(0, len(held.data))
        end = min(len(held.data), start + rng.randint(0, 4))
        whole = held.data[:start] + b"rest" + held.data[end:]
        assert held.edit(start, end, b"rest") <= len(whole)
        assert held.data == whole and held.ids() == merged(whole)


def test_edit_works_near_the_change_only():
    held = bpe.Prefixes(bpe.Ranks.load(PATH), b"there is no other thing in the rain " * 300)
    assert held.edit(100, 102, b"xy") < 200


def test_digests(spark, library, sf_dir):
    texts = [None, "", "a", "It's 1 of 2\n\n  rows ", "naïve 中文 😀", "long " * 60_000, "a", *thue_morse(1024), *thue_morse(2048)]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "no key", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens int")
    found = {r["doc_id"]: r for r in bpe.digests(docs, PATH).collect()}
    assert len(found) == len(rows)
    for key, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert found[key]["n_tokens"] == len(ids)
        assert found[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_encode_and_decode(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == [*docs.columns, "ids"]
    back = bpe.decode(coded, PATH)
    assert back.filter(~bpe.exact(back["text"], back["bytes"])).count() == 0
    for row in coded.limit(20).collect():
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
