import hashlib
import random

import pytest

from dissensus.llm import exactdedup

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    out = []
    for key, text in rows:
        norm = (text or "").translate(LOWER)
        known = [k for k in groups[norm] if k is not None]
        out.append((key, max(known, default=None), len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' AS piece", "1 AS place", "2 AS mark", "3 AS row")


def check(spark, rows):
    docs = table(spark, rows)
    found = exactdedup.groups(docs).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[3])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=order)
    assert got == sorted(plain(rows), key=order)
    kept = [(r["keep_id"], r["text_sha256"]) for r in found if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in found})
    stay = exactdedup.keep_newest(docs)
    assert stay.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in stay.collect()))) == sorted(
        {repr((keep, (text or "").translate(LOWER))) for (_, text), (_, keep, *_) in zip(rows, plain(rows))}
    )


def test_edges(spark):
    check(spark, [(1, "A b"), (2, "a B"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "a b"), (None, None), (7, "x" * 200_000), (8, "X" * 200_000), (9, "x" * 199_999)])


def test_empty(spark):
    docs = table(spark, [(1, "a")]).limit(0)
    assert exactdedup.groups(docs).count() == 0 and exactdedup.keep_newest(docs).count() == 0


def test_common_text_is_split(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Same", "same", "SAME"]) if i % 3 else f"text {i % 200}") for i in range(2000)]
    rows += [(None, "same"), (1999, "same"), (1999, "same")]
    pieces = exactdedup.sorted_rows(table(spark, rows), "doc_id", "text", {}).filter("norm = 'same'").select("piece").distinct().count()
    assert pieces > 32
    check(spark, rows)


def test_tables(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("name", ["groups", "keep_newest"])
def test_no_python(spark, sf_dir, name):
    plan = exactdedup.sorted_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", {})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and text.count("rangepartitioning") == 1
