import collections
import random
import re

import numpy as np

from dissensus.llm import decontaminate, words

WORD = re.compile(words.WORD_PATTERN)


def plain(text):
    return " " + " ".join(WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))) + " "


def test_radius_is_guaranteed():
    """Every pair of fingerprints within the radius is found, and no other."""
    rng = np.random.default_rng(1)
    index = decontaminate.build(list(range(30)), [" ".join(f"{i}w{k}" for k in range(20)) for i in range(30)])
    c = index.classes[0]
    base = rng.choice(c.prints, 3000)
    flips = np.zeros(3000, np.uint64)
    for i in range(3000):
        for b in rng.choice(64, rng.integers(0, 12), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    found = base ^ flips
    at, which = decontaminate.near(c, found)
    got = set(zip(at.tolist(), which.tolist()))
    far = np.bitwise_count(found[:, None] ^ c.prints[None, :])
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= decontaminate.RADIUS))))


def test_prints_are_the_definition():
    w = words.word_hashes(["a b c a d e f g h i j"])
    weights = np.array([1, 2, 3, 1, 3, 3, 2, 1, 1, 3, 2], np.uint8)
    found = decontaminate.prints(w.hashes, weights, np.arange(7), 5)
    mixed = words.mix(w.hashes)
    for s in range(7):
        bits = 0
        for b in range(64):
            ones = sum(int(weights[s + k]) for k in range(5) if int(mixed[s + k]) >> b & 1)
            if ones > weights[s : s + 5].sum() // 2:
                bits |= 1 << b
        assert int(found[s]) == bits


def test_tables_against_a_search(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    texts = [(r["doc_id"], plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
    held = {(d, i) for d, t in texts for i, p in items if p in t}
    assert held and held <= found
    assert len(found - held) <= 0.05 * len(held)
    left = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in found}


def test_edited_passages(spark):
    """Passages with words put in, left out or changed, next to ones too far away."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [[word() for _ in range(n)] for n in (15, 25, 40, 59)]
    fill = lambda n: [word() for _ in range(n)]
    rows, near, far = [], set(), set()
    for k in range(40):
        i = k % 4
        item = list(items[i])
        kind = k // 4 % 3
        if kind == 0:
            pass
        elif kind == 1:
            del item[-1]
        else:
            item[0] = word()
        rows.append((k, " ".join(fill(k) + item + fill(60 - k))))
        (near if kind == 0 or i > 0 else far).add((k, i))
    for k in range(40, 60):
        item = list(items[k % 4])
        for at in range(2, len(item), 6):
            item[at] = word()
        rows.append((k, " ".join(fill(9) + item + fill(9))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert near <= set(found) and not any(d >= 40 for d, _ in found)
    assert all(r["similarity"] >= 0.8 for r in found.values())
    assert found[0, 0]["first_word"] == 0 and found[1, 1]["first_word"] == 1 and found[1, 1]["n_words"] == 25


def plain_similarity(a, b, weight):
    """Weighted Jaccard of the five-word shingles of two runs of words."""
    x, y = collections.Counter(), collections.Counter()
    for out, run in ((x, a), (y, b)):
        for i in range(max(1, len(run) - 4)):
            out[tuple(run[i : i + 5])] += sum(weight[w] for w in run[i : i + 5])
    both = sum(min(x[k], y[k]) for k in x)
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_recall_of_edited_passages():
    """Of passages that are 0.8 like their item, cut at an end or changed inside, with words
    of all weights, nine in ten are found at the least; those found have the best span's
    similarity or more than that of the part that was put in."""
    rng = random.Random(9)
    common, usual = [f"c{i}" for i in range(12)], [f"u{i}" for i in range(60)]
    word = lambda: rng.choice(common) if rng.random() < 0.2 else rng.choice(usual) if rng.random() < 0.3 else f"r{rng.randrange(10**9)}"
    items = [[word() for _ in range(n)] for n in (40, 49, 55, 80, 120, 300)]
    index = decontaminate.build(list(range(len(items))), [" ".join(x) for x in items])
    weights = dict(zip(index.known.tolist(), index.weights.tolist()))
    weight = collections.defaultdict(lambda: 3)
    for w in {w for x in items for w in x}:
        weight[w] = weights[int(words.word_hashes([w]).hashes[0])]
    asked = collections.Counter()
    hit = collections.Counter()
    for i, item in enumerate(items):
        for kind in ("front", "back", "middle", "both"):
            for _ in range(6):
                part = list(item)
                if kind in ("front", "both"):
                    part = part[rng.randint(0, len(item) // 9) :]
                if kind in ("back", "both"):
                    part = part[: len(part) - rng.randint(0, len(item) // 9)]
                if kind == "middle":
                    part[rng.randrange(8, len(item) - 8)] = "changed"
                own = plain_similarity(part, item, weight)
                if own < 0.8:
                    continue
                asked[kind] += 1
                before, after = ([f"f{rng.randrange(10**9)}" for _ in range(rng.randint(0, 30))] for _ in range(2))
                found = decontaminate.matches(index, words.word_hashes([" ".join([*before, *part, *after])]))
                alike = {m[1]: m[2] for m in found}
                hit[kind] += i in alike
                assert i not in alike or alike[i] >= min(own, 0.8) - 1e-9
    assert all(asked[k] > 20 and hit[k] >= 0.9 * asked[k] for k in ("front", "back", "middle", "both")), (asked, hit)
    assert max(c.window for c in index.classes) > 200


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "One two THREE"), (None, "one two three"), (3, "One two THREE"), (4, "x " * 100_000 + "one, two three"), (5, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS similarity", "3 AS item")
    bench = spark.createDataFrame([(7, "one two three"), (8, None), (9, "--"), (None, "nothing like it at all")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"], r["similarity"]) for r in found) == [(0, 7, 1.0), (3, 7, 1.0), (3, 7, 1.0), (4, 7, 1.0)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 5]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), bench).count() == 0
