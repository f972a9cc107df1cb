"""Wavelet matrices against plain arrays, files against the library's ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dissensus.llm import pretokens, queries, tokenfiles
from tests.llm.test_text import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size,top", [(0, 3), (1, 1), (511, 2), (512, 9), (5000, 50257), (2000, 100_000)])
def test_wavelet_matrix(size, top):
    rng = np.random.default_rng(size)
    values = rng.integers(0, top, size) // rng.integers(1, 40, size) if size else np.zeros(0, np.int64)
    m = tokenfiles.WaveletMatrix.of(values)
    assert m.values().tolist() == values.tolist()
    at = rng.integers(0, size, 50) if size else np.zeros(0, np.int64)
    assert m.access(at).tolist() == values[at].tolist()
    for v in [*values[:5].tolist(), top + 5]:
        places = np.flatnonzero(values == v)
        assert m.count(v) == len(places) and m.count(v, size // 2) == (places < size // 2).sum()
        assert m.select(v, np.arange(len(places))).tolist() == places.tolist()
        with pytest.raises(IndexError):
            m.select(v, np.array([len(places)]))


def test_file_round_trip_and_damage():
    held = tokenfiles.TokenFile(np.array([3, 0]), np.array([True, False]), np.array([2, 1]), tokenfiles.WaveletMatrix.of(np.array([7, 0, 0])))
    data = held.to_bytes()
    back = tokenfiles.TokenFile.from_bytes(data)
    assert back.keys.tolist() == [3, 0] and back.known.tolist() == [True, False] and back.matrix.values().tolist() == [7, 0, 0]
    with pytest.raises(ValueError):
        tokenfiles.TokenFile.from_bytes(data[:-1])


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_corpus_is_that_of_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = tokenfiles.corpus(docs, PATH).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected(rows)


def test_nulls_repeats_and_many_files(spark, tmp_path):
    texts = [None, "", "<|endoftext|> !", "x " * 40_000, "b", "b", *thue_morse(1024), *thue_morse(2048)]
    rows = [(19 - i, t) for i, t in enumerate(texts)] + [(None, "no key"), (4, "b")] + [(100 + i, "w") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.selectExpr("doc_id", "text", "1 AS part", "'x' AS file", "2 AS start")
    listed = tokenfiles.write(docs, PATH, str(tmp_path / "files"), file_ids=20)
    assert listed.count() > 1 and listed.agg({"n_docs": "sum"}).first()[0] == len(rows)
    found = tokenfiles.corpus(docs, PATH).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == [
        ((k is not None, k or 0), *rest) for k, *rest in expected(rows)
    ]
    assert tokenfiles.corpus(docs.limit(0), PATH).count() == 0


def test_query_gives_the_librarys_ids_of_added_tokens(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|> !", "plain it's", "", None, "<|endoftext|>" * 3, "<|endoftext", "x" * 3000 + "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op7_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect()
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for text, r in zip(texts, found):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_bits_are_moved_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    sizes, real = [], np.flatnonzero
    monkeypatch.setattr(tokenfiles.np, "flatnonzero", lambda x: sizes.append(len(x)) or real(x))
    for moved in (tokenfiles.MOVED, 64):
        monkeypatch.setattr(tokenfiles, "MOVED", moved)
        for n in (0, 1, 63, 64, 65, 1000, 2 * moved + 7):
            for top in (1, 2, 50_000, 1 << 20):
                values = rng.integers(0, top, n).astype(np.uint32)
                assert (tokenfiles.WaveletMatrix.of(values).values() == values).all()
        assert max(sizes) <= moved
        sizes.clear()


def test_only_distinct_hashes_are_sorted(monkeypatch):
    keys = np.random.default_rng(6).integers(0, 2**64, 300, dtype=np.uint64)[np.random.default_rng(7).integers(0, 300, 5000)]
    sizes, real = [], np.argsort
    wanted = np.unique(keys, return_index=True, return_inverse=True)
    monkeypatch.setattr(pretokens.np, "argsort", lambda x, **k: sizes.append(len(x)) or real(x, **k))
    assert all((a == b).all() for a, b in zip(pretokens.grouped(keys), wanted))
    assert sizes == [len(wanted[0])]


def test_spelling_of_pieces_is_that_of_their_bytes():
    memo, _ = tokenfiles.coder(PATH)
    letters = dict(enumerate(tokenfiles.byte_letters()))
    model = Tokenizer.from_file(PATH).model
    pieces = [" a", "a b", "\x00", "\x1f\x7f", "\t\n", "~!", " é", "…", " ", "\xa0", " 日本", "😀", " ", "  "]
    assert memo.encode(pieces) == [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]
