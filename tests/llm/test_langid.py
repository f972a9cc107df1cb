import numpy as np
import pytest
from pyspark.sql import functions as F

from dissensus.llm import langid


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, langid.train(docs.filter("doc_id % 2 = 0"))


def test_held_out_documents(model):
    docs, fitted = model
    found = langid.identify(langid.text_evidence(docs.filter("doc_id % 2 = 1")), fitted)
    joined = found.join(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("truth")), "key").collect()
    known = [r for r in joined if r["text_lang"]]
    assert sum(r["lang"] == r["truth"] for r in known) > 0.97 * len(known)


def test_pages(spark, sf_dir, model):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = langid.identify(langid.page_evidence(pages), model[1]).collect()
    assert len(found) == pages.count()
    assert sum(r["lang"] == r["declared"] for r in found) > 0.97 * len(found)
    assert all(0 < r["score"] <= 1 for r in found)


def test_host_and_markup_decide_where_the_text_does_not(spark, model):
    en, fr = "the thing of that and the ", "les éement de la que les "
    html = lambda lang, text: f"<html lang='{lang}'><p>{text}</p></html>"
    rows = [(i, "http://a.fr/fr/", html("fr", fr * 5)) for i in range(30)]
    rows += [(100 + i, "http://b.org/en/", html("en", en * 5)) for i in range(60)]
    rows += [(200, "http://a.fr/fr/", html("fr", "")), (201, "http://sub.a.fr/", "12"), (202, "http://new.net/", html("fr", "7")), (203, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["key"]: r for r in langid.identify(langid.page_evidence(pages), model[1]).collect()}
    assert [found[k]["lang"] for k in (0, 100, 200, 201, 202, 203)] == ["fr", "en", "fr", "fr", "fr", "en"]
    assert found[200]["text_lang"] is None or found[200]["score"] < found[0]["score"]


def test_edges(spark, model):
    rows = [(1, None, None), (None, "", "s"), (1, None, None), (2, "the " * 100_000, "s"), (3, "é", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'k' AS key", "1 AS host", "'x' AS lang", "2 AS p0")
    found = langid.identify(langid.text_evidence(docs), model[1]).collect()
    assert sorted(repr(r["key"]) for r in found) == ["1", "1", "2", "3", "None"]
    assert all(r["lang"] is not None for r in found)
    assert langid.identify(langid.text_evidence(docs.limit(0)), model[1]).count() == 0
    nothing = langid.train(docs.limit(0))
    assert [(r["lang"], r["score"]) for r in langid.identify(langid.text_evidence(docs), nothing).collect()] == [(None, 0.0)] * 5


def test_arrays_give_what_columns_give(spark, sf_dir, model, monkeypatch):
    pages = langid.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    blank = spark.createDataFrame([(-1, None, None), (-1, "", "x.fr"), (-2, "é", "x.fr")], "doc_id long, text string, source string")
    rows = pages.unionByName(langid.text_evidence(blank))
    by_column = langid.identify(rows, model[1]).collect()
    monkeypatch.setattr(langid, "MAX_COLUMNS", 1)
    monkeypatch.setattr(langid, "NUMBERS", 1000)
    by_array = langid.identify(rows, model[1])
    assert by_array.columns == ["key", "lang", "score", "text_lang", "declared", "host"]
    order = lambda r: (r["key"], r["text_lang"] or "", r["host"] or "")
    for a, b in zip(sorted(by_column, key=order), sorted(by_array.collect(), key=order), strict=True):
        assert [a[c] for c in ("key", "lang", "text_lang", "declared", "host")] == [b[c] for c in ("key", "lang", "text_lang", "declared", "host")]
        assert abs(a["score"] - b["score"]) < 1e-4
    assert langid.identify(rows.limit(0), model[1]).count() == 0


def test_more_languages_than_columns(spark):
    n = langid.MAX_COLUMNS + 20
    word = lambda i: "".join(chr(97 + (i // 26**k + 7 * k) % 26) for k in range(3))
    rows = [(i, f"{word(i)} " * 30, f"x{i:03}", "s") for i in range(n)] + [(n, None, None, None), (n + 1, "", "x000", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fitted = langid.train(docs)
    assert len(fitted.languages) == n
    found = {r["key"]: r for r in langid.identify(langid.text_evidence(docs), fitted).collect()}
    assert len(found) == n + 2
    assert all(found[i]["lang"] == f"x{i:03}" == found[i]["text_lang"] for i in range(n))
    assert found[n]["text_lang"] is None and found[n]["lang"] is not None


def test_long_texts_are_summed_in_parts(model, monkeypatch):
    data = np.frombuffer(b"the thing of that and les que la" * 50, np.uint8)
    offsets = np.array([0, 0, 700, 703, 703, len(data)])
    whole = model[1].evidence(data, offsets)
    monkeypatch.setattr(langid, "NUMBERS", 64 * len(model[1].languages))
    assert np.allclose(model[1].evidence(data, offsets), whole, rtol=1e-4)
    assert not whole[[0, 3]].any()
