"""Ranked search against the score's definition on all documents."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dissensus.llm import lexical, words
from tests.llm.test_text import thue_morse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def expected(docs, items):
    held = [(key, collections.Counter(terms(text))) for key, text in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n, size = len(held), sum(k for *_, k in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for key, c, k in held:
            m = 75 + (25 * k * n) // size
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t]
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, i, None if none else key, -score) for i, (score, none, key) in enumerate(sorted(scored)[:20], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(900)]
    return [" ".join(rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rare, k=rng.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("bucket,items", [(2048, 1 << 14), (16, 1 << 14), (64, 9)])
def test_ranks_against_all_scores(spark, monkeypatch, bucket, items):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "ITEMS", items)
    rng = random.Random(1)
    texts = corpus(rng, 900) + ["same words here"] * 50 + ["SAME words, here!", None, "", "...", "w1 " * 30_000, "é中 É", *thue_morse(1024)]
    docs = [(10_000 - i, t) for i, t in enumerate(texts)] + [(None, "w1 r1"), (7, "r5 r5"), (7, "r5 r5")]
    asked = corpus(rng, 30) + ["same words here", "w1", "r1 r1 r1 r2", None, "", "unknown", "É é", " ".join(thue_morse(1024)), "w1 w2 " * 400]
    wanted = [(i, t) for i, t in enumerate(asked)] + [(3, "again r7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS item", "3 AS n", "'x' AS item_id").repartition(5)
    against = spark.createDataFrame(wanted, "item_id long, text string").selectExpr("*", "'y' AS name", "1 AS doc_id")
    found = lexical.rank(frame, against)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(docs, wanted)


def test_whole_documents(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = sorted((tuple(r) for r in lexical.rank(docs, items).collect()), key=str)
    assert found == expected(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some, asked = spark.createDataFrame([(1, "a b")], docs.schema), spark.createDataFrame([(1, "a")], items.schema)
    assert lexical.rank(docs, asked).count() == 0 and lexical.rank(some, items).count() == 0
    assert lexical.rank(some, spark.createDataFrame([(1, None)], items.schema)).count() == 0


def test_terms_of_one_hash_are_compared(monkeypatch):
    texts = ["ab", "cd", "abc", "x"]
    held = lexical.Terms(texts)
    held.hashes = np.zeros(4, dtype=np.uint64)
    data, offsets = words.utf8(pa.array(["cd x AB zz", "abc abd"], pa.string()))
    w = words.words(data, offsets)
    w.hashes = np.zeros(len(w.hashes), dtype=np.uint64)
    assert held.of(data, w).tolist() == [1, 3, 0, -1, 2, -1]


def test_short_vectors_are_passed_over():
    """Buckets of vectors too short for the threshold, and vectors that only have light
    coordinates, are not scored."""
    items = lexical.Items.of([(0, "a b c")])
    weights = np.array([5000, 4000, 30], dtype=np.int64)
    search = lexical.Search(items, weights, np.array([10**12], dtype=np.int64))
    row = lambda length, terms, values: {"key": 1, "length": length, "terms": terms, "impacts": values}
    schema = pa.schema([("key", pa.int64()), ("length", pa.float64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])
    assert search._bucket(pa.RecordBatch.from_pylist([row(10.0, [2], [1])], schema)) is False
    search.least[:] = 1
    assert search._bucket(pa.RecordBatch.from_pylist([row(500_000 * 30**0.5, [2], [500_000])], schema)) is True
    assert search.best[0][0].tolist() == [15_000_000]
