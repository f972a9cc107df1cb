"""URL rules, licences and toxicity on small tables, against plain Python."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from dissensus.llm import licenses, queries, toxicity, urlfilter

RULES = [*queries.RULES, ("block", "co.uk/a/b"), ("allow", "x/"), ("block", "example.org/")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def plain_rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        name, _, begin = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + begin):
            fits.append((-len(rule), rule, verdict))
    return min(fits, default=None)


URLS = [
    None, "", "no scheme", "http://", "://", "http:///p", "HTTPS://A.Example.ORG/es/x", "http://example.org/en/12?x=/es/",
    "http://example.org", "http://example.org?x", "http://notexample.org/es/", "ftp://com/fr/", "http://a.b.co.uk/a/bc#f",
    "http://x/y://z/", "http://É.org/É", "http://www.q.net/p/", "http://q.net/p", "http://q.net/p?again", "http://x.com/de/" + "y" * 100_000,
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.org/"), (3, "http://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'k' AS key", "1 AS host", "2 AS verdict")
    found = urlfilter.judge(pages, urlfilter.rule_table(spark, RULES), urlfilter.repeated(pages)).collect()
    got = sorted((repr(r["page_id"]), r["host"], r["path"], r["rule"] or "", r["verdict"], r["listed"]) for r in found)
    canon = lambda h, p: re.sub(r"^www\.", "", h) + re.sub(r"/+$", "", p)
    seen = [canon(*plain_parts(u)) for _, u in rows]
    want = []
    for (key, url), c in zip(rows, seen):
        host, path = plain_parts(url)
        best = plain_rule(host, path, RULES)
        listed = c != "" and seen.count(c) > 1
        want.append((repr(key), host, path, best[1] if best else "", best[2] if best else "block" if listed else "allow", listed))
    assert got == sorted(want)


def test_urls_without_rules_list_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    rules, listed = urlfilter.rule_table(spark, RULES), urlfilter.repeated(pages)
    none = urlfilter.judge(pages, rules.limit(0), listed.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert urlfilter.judge(pages.limit(0), rules, listed).count() == 0


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    blocks = urlfilter.Blocks.of(keys)
    assert urlfilter.possible(keys, blocks).count() == 20_000
    assert urlfilter.possible(spark.range(20_000).selectExpr("concat('x', id) AS key"), blocks).count() < 400


def test_licences_against_sql(spark):
    rng = random.Random(2)
    parts = ["GNU", "general", "Public", "license", "apache", "License,", "cc", "BY", "nc", "mit", "version", "3", "2.0", "Licensed under the", "é", "word"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "..."), (303, "MIT license"), (304, "Released under the MIT License. mit license"), (None, "cc by"), (303, "MIT license")]
    rows += [(305, "gnu " * 3000 + "general public license"), (306, "x" * 100_000), (307, "cc by cc by-nc 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = docs.selectExpr("*", "'w' AS words", "1 AS hits", "2 AS t0")
    found = licenses.scan(named)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({licenses.sql()})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    by_id = {r[0]: r for r in got}
    assert by_id[304][1:7] == (7, 2, 3, 5, "mit", "mit") and by_id[304][7] == 1.0
    assert by_id[307][2] == 2 and by_id[307][6] == "cc-by,cc-by-nc"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_listed_addresses_without_a_host(spark):
    urls = ["file:///x", "file:///x/", "file:///y", "http://a.org/", "http://a.org", "mailto:me", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.judge(pages, urlfilter.rule_table(spark, [("allow", "b.org/")]), urlfilter.repeated(pages)).collect()
    assert sorted(r["page_id"] for r in found if r["verdict"] == "block") == [0, 1, 3, 4]
    assert [r["listed"] for r in sorted(found, key=lambda r: r["page_id"])] == [True, True, False, True, True, False, False]


SMALL = toxicity.Settings(epochs=8, rows_per_label=1000)
BAD = {"en": ["scum", "moron"], "de": ["bloed", "depp"]}


def labelled(n=1600, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [lang[0] + str(rng.randint(0, 900)) for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD[lang])
        rows.append((i, " ".join(words), lang))
        marks.append((i, toxic))
    return rows, marks


@pytest.fixture(scope="module")
def model(spark):
    rows, marks = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    return docs, dict(marks), toxicity.train(docs, labels, settings=SMALL)


def test_toxicity_on_held_out_rows(model):
    docs, marks, fitted = model
    found = [r for r in toxicity.score(docs, fitted).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(found) > 300
    assert np.mean([(r["score"] >= 0.3) == marks[r["doc_id"]] for r in found]) > 0.97
    assert np.mean([r["toxic"] == marks[r["doc_id"]] for r in found]) > 0.97
    assert set(fitted.thresholds) == {None, "en", "de"}


def test_score_does_not_depend_on_neighbours(model):
    docs, _, fitted = model
    together = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fitted).collect()}
    alone = toxicity.score(docs.filter("doc_id IN (3, 700)").repartition(2), fitted).collect()
    assert all(abs(together[r["doc_id"]] - r["score"]) < 1e-5 for r in alone)


def test_toxicity_edges(spark, model):
    _, _, fitted = model
    rows = [(1, None, "en"), (2, "", None), (3, "Scum!", "xx"), (None, "e1 moron e2", "en"), (3, "Scum!", "xx"), (4, "e5 " * 50_000, "en"), (5, "e5 " * 50_000 + "scum", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS score", "1 AS toxic", "2 AS key")
    found = [(r["doc_id"], r["toxic"]) for r in toxicity.score(docs, fitted).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, [(1, False), (2, False), (3, True), (None, True), (3, True), (4, False), (5, True)]))
    kept = toxicity.accepted(docs, fitted)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert toxicity.accepted(docs.limit(0), fitted).count() == 0


@pytest.mark.parametrize("labels", ["doc_id < 0", "toxic = 0", "toxic = 1"])
def test_too_few_labels_give_their_share(spark, labels):
    rows, marks = labelled(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id long, toxic int").filter(labels)
    fitted = toxicity.train(docs, some, settings=SMALL)
    scores = {round(r["score"], 4) for r in toxicity.score(docs, fitted).collect()}
    assert scores == {1.0 if labels == "toxic = 1" else 0.0}


def test_thresholds_come_from_all_rows_of_the_fold(spark, monkeypatch):
    rows, marks = labelled(900)
    rows = [(i, t + " e1" * (5000 if i % 9 == 0 else 0), lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    # The sample has few of the rows, as many of either label, and no long text.
    fitted = toxicity.train(docs, labels, settings=toxicity.Settings(epochs=3, rows_per_label=60))
    of, langs = dict(marks), {i: lang for i, _, lang in rows}
    fold = [r for r in toxicity.score(docs, fitted).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == toxicity.CALIBRATION]
    for lang in (None, "en", "de"):
        mine = [r for r in fold if lang in (None, langs[r["doc_id"]])]
        scores, hits = np.array([r["score"] for r in mine]), np.array([of[r["doc_id"]] for r in mine])
        f1 = lambda cut: 2 * hits[scores >= cut].sum() / ((scores >= cut).sum() + hits.sum())
        best = f1(toxicity.best_threshold(scores, hits))
        assert f1(fitted.thresholds[lang]) >= best - 0.02


def test_threshold():
    scores, labels = np.array([0.1, 0.2, 0.6, 0.9]), np.array([0, 0, 1, 1])
    assert abs(toxicity.best_threshold(scores, labels) - 0.4) < 1e-9
    assert toxicity.best_threshold(np.array([0.5, 0.5]), np.array([0, 1])) <= 0.5
