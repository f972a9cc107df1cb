"""Classes of near duplicates against all pairs."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dissensus.llm import components, minhash, words

WORD = re.compile(words.WORD_PATTERN)


def bags(texts):
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    return out


def similarity(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def plain_classes(rows):
    rows = [r for r in rows if r[0] is not None]
    found = bags([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = found[i], found[j]
            if rows[i][0] == rows[j][0] or (a and b and len(a.keys() & b.keys()) >= 0.5 * max(len(a), len(b)) and similarity(a, b) >= 0.8):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted((key, least[root(i)]) for i, (key, _) in enumerate(rows))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else "w" + str(rng.randint(0, 10**6)) for w in text.split())


def test_similarity_is_the_definition():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (collections.Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in range(2))
        side = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        assert abs(minhash.probability_jaccard(side(a), side(b)) - similarity(a, b)) < 1e-12


def test_registers_estimate_the_similarity():
    rng = random.Random(4)
    gaps = []
    for _ in range(40):
        base = " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.choice([40, 400])))
        texts = [base + " and so on and so on", edited(rng, base, rng.choice([0.01, 0.05])) + " and so on"]
        rows, values, weights = minhash.weighted_shingles(words.word_hashes(texts))
        held = minhash.signatures(rows, values, weights, 2)
        a, b = bags(texts)
        gaps.append((held[0] == held[1]).mean() - similarity(a, b))
    assert abs(np.mean(gaps)) < 0.03 and np.max(np.abs(gaps)) < 0.25


def test_one_shingle_fills_all_registers():
    rows, values, weights = minhash.weighted_shingles(words.word_hashes(["only these words"]))
    assert len(set(minhash.signatures(rows, values, weights, 1).ravel().tolist())) == 1


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    rows, key = [], 0
    for group in range(40):
        base = " ".join(word() for _ in range(rng.choice([4, 30, 80, 300])))
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((key, edited(rng, base, rng.choice([0, 0.004, 0.02]))))
            key += 1
    base = " ".join(word() for _ in range(120))
    for _ in range(60):  # many alike
        rows.append((key, edited(rng, base, 0.01)))
        key += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(40):  # a common passage, else different
        rows.append((key, passage + " " + " ".join(word() for _ in range(60))))
        key += 1
    return rows


def test_classes_against_all_pairs(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "... --"), (903, "Two Words"), (904, "two, words!"), (905, "long " * 60_000), (None, "two words"), (None, None), (903, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'b' AS bucket", "2 AS a")
    found = minhash.classes(docs).collect()
    assert len(found) == len(rows)
    assert sorted((r["doc_id"], r["class_id"]) for r in found if r["doc_id"] is not None) == plain_classes(rows)
    assert [(r["class_id"], r["class_size"]) for r in found if r["doc_id"] is None] == [(None, 1)] * 2
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    heads = sorted({c for _, c in plain_classes(rows)})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == heads


def linked(texts):
    """Classes of texts without repeated shingles, by all pairs."""
    found = [set(b) for b in bags(texts)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def own(rng, n):
    return [f"u{rng.randrange(10**12)}" for _ in range(n)]


def template_pages(rng, shared, pages=60):
    """Pages of 400 words, of which ``shared`` come from a template; two and two have a
    few of the other words in common as well."""
    template, texts = own(rng, shared), []
    for _ in range(pages):
        # Shingles of both: 0.82 of those that either holds.
        both = own(rng, round(400 * 2 * 0.82 / 1.82) + 4 - shared)
        texts += [" ".join(template + both + own(rng, 400 - shared - len(both))) for _ in range(2)]
    return texts


def two_groups(rng):
    """Two groups of copies around a template, and a text of either that bridge them."""
    template, x, y, z = own(rng, 352), own(rng, 48), own(rng, 48), own(rng, 14)
    texts = []
    for side in (x, y):
        texts += [" ".join(template + side[:-2] + own(rng, 2)) for _ in range(20)]
        texts.append(" ".join(template + z + side[14:]))
    return texts


def test_crowded_buckets_leave_no_pair_out(spark):
    rng = random.Random(12)
    texts = template_pages(rng, 352) + template_pages(rng, 340)
    for _ in range(8):
        texts += two_groups(rng)
    expected = linked(texts)
    # Unlike pages of a template, pairs that are alike, and groups that only a bridge joins.
    assert 100 < len(set(expected)) < 140
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def crowd_of(spark, texts, roots=None):
    rows = [(i, (roots or {}).get(i, i), t) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, root long, text string")
    held = minhash.sketches(nodes, "node", "text").selectExpr("key AS node", "registers")
    return minhash.crowds(nodes.selectExpr("7L AS bucket", "node", "root")), nodes, held


@pytest.mark.parametrize("block", [7, 4096])
def test_crowds_of_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "CROWD_BLOCK", block)
    texts = template_pages(random.Random(5), 352, 30)
    # A class of thirty texts, which only one of the others is alike to.
    rng = random.Random(6)
    base = texts[0].split()
    texts += [" ".join(base[:-2] + own(rng, 2)) for _ in range(30)]
    roots = {i: 60 for i in range(60, 90)}
    found = minhash.crowd_links(*crowd_of(spark, texts, roots)).collect()
    assert {(r["a"], r["b"]) for r in found} >= {(i, i + 1) for i in range(2, 60, 2)}
    assert any(r["a"] in (0, 1) and r["b"] >= 60 for r in found)
    seen = bags(texts)
    for r in found:
        assert r["similarity"] >= 0.8 and abs(r["similarity"] - similarity(seen[r["a"]], seen[r["b"]])) < 1e-9
    assert block == 7 or len(found) < len(texts)


def test_binary_columns_are_read_in_place():
    rows = [b"abcd", b"", b"efgh", b"ijkl"]
    column = pa.chunked_array([pa.array(rows[:2], pa.binary()), pa.array(rows[2:], pa.binary())])
    assert minhash.contents(column.slice(1), "<u4").tobytes() == b"efghijkl"
    assert len(minhash.contents(column.slice(1, 1), "<u4")) == 0


def test_a_text_is_compared_in_slices(spark, monkeypatch):
    texts = template_pages(random.Random(5), 352, 20)
    links = lambda: {(r["a"], r["b"]) for r in minhash.crowd_links(*crowd_of(spark, texts)).collect()}
    whole = links()
    monkeypatch.setattr(minhash, "CROWD_SLICE", 1)
    assert whole and links() == whole


def test_a_crowd_gives_out_links_not_pairs(spark):
    """Some thousand near copies of one text, all in different classes so far."""
    rng = random.Random(7)
    base = own(rng, 60)
    texts = [" ".join(base[:-1] + own(rng, 1)) for _ in range(2500)]
    found = minhash.crowd_links(*crowd_of(spark, texts)).collect()
    assert len(found) == len(texts) - 1


def test_one_of_each_keeps_unlike_texts_of_a_repeated_key(spark):
    rng = random.Random(3)
    x, y, z = (" ".join(own(rng, 30)) for _ in range(3))
    rows = [(1, x, 1), (3, x, 2), (3, y, 3), (3, y, 3), (4, z, 4), (2, z, 5), (None, x, 6), (5, None, 7), (5, "", 8)]
    docs = spark.createDataFrame(rows, "key long, text string, __key int").selectExpr("*", "'a' AS __place", "'b' AS row", "1 AS `a.b`")
    kept = minhash.one_of_each(docs, "key")
    assert kept.columns == docs.columns
    found = [tuple(r)[:3] for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(1, x, 1), (3, y, 3), (2, z, 5), (None, x, 6), (5, None, 7)], key=str)
    names = docs.selectExpr("'k' || key AS key", "text")
    assert sorted(r["key"] for r in minhash.one_of_each(names, "key").collect() if r["key"]) == ["k1", "k2", "k3", "k5"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(docs).count() == 0 and minhash.one_of_each(docs).count() == 0


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert found == {n: root(n) for n in list(parent)}


@pytest.mark.parametrize("kind", ["long", "string", "decimal(38,0)"])
def test_components_within_a_task_and_across_tasks(spark, monkeypatch, kind):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] * 2 + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    rows = spark.createDataFrame(links, "a long, b long").selectExpr(f"CAST(a AS {kind}) AS a", f"CAST(b AS {kind}) AS b")
    jobs, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: jobs.append(name) or real(df, name))
    one = sorted(map(tuple, components.components(rows).collect()))
    # Links that fit one task take no rounds of joins.
    assert len(jobs) == 2 and len(one) == len({x for x, _ in one})
    monkeypatch.setattr(components, "TASK_LINKS", 16)
    assert sorted(map(tuple, components.components(rows).collect())) == one and len(jobs) > 5
    nothing = rows.filter("a < '0'" if kind == "string" else "a < 0")
    assert components.components(nothing).count() == 0
