"""The pipeline stage by stage against plain Python on a small table."""

import hashlib

import corpus_pipeline
from dissensus.llm import toxicity

from . import test_decontaminate as passages
from . import test_minhash as near

LOWER = {i: i + 32 for i in range(65, 91)}


def test_stages(spark, tmp_path):
    rows = [(key, text + " and more of it") for key, text in near.corpus(5)]
    item = "this very passage is part of a benchmark and must not be in the data we keep for training at all"
    rows += [(500, rows[3][1].upper()), (501, rows[3][1]), (502, f"before it {item} after it"), (503, "scum " * 4), (504, None), (505, "")]
    marks = [(k, 0) for k, _ in rows if k < 500]
    bad = [(600 + i, f"some {w} here number {i}") for i in range(60) for w in ["scum"]]
    rows, marks = rows + bad, marks + [(k, 1) for k, _ in bad]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for name, table in (
        ("documents", docs), ("labels", spark.createDataFrame([(k, 1, t) for k, t in marks], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string")),
    ):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter("toxic").collect()}
    assert {k for k, _ in bad} <= toxic and 503 in toxic and len(toxic) <= len(bad) + 3
    left = [(k, t) for k, t in rows if k not in toxic]
    newest = {}
    for key, text in left:
        norm = (text or "").translate(LOWER)
        newest[norm] = max(key, newest.get(norm, key))
    left = [(k, t) for k, t in left if k in newest.values()]
    heads = {c for _, c in near.plain_classes(left)}
    left = [(k, t) for k, t in left if k in heads and passages.plain(item) not in passages.plain(t)]
    assert set(got) == {k for k, _ in left} and 502 not in got
    for key, text in left:
        assert got[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
