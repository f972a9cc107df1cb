"""Keyed JSON files against the json module, cut at many places."""

import json

import pytest

from dissensus.sources import items, keyed_json


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "40b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def noisy(i):
    texts = ['a "quote" and {brace}', "}{}}", 'ends in \\', '\\"}', "é}ü{", "", "line\nbreak}", '":{"']
    return {"text": texts[i % len(texts)], "more": {"deep": {"x": texts[(i * 3) % len(texts)]}}, "list": [{"a}": i}, {}]}


@pytest.mark.parametrize("indent", [None, 2])
def test_entries_of_a_file_cut_anywhere(spark, small_ranges, tmp_path, indent):
    data = {(f'k"{i}}}' if i % 5 == 0 else f"k{i}"): noisy(i) for i in range(60)}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(data, indent=indent, ensure_ascii=False) + ("\n" if indent else ""), encoding="utf8")
    assert keyed_json.fragments(spark, str(path)).rdd.getNumPartitions() > 20
    kind = "struct<text:string,more:struct<deep:struct<x:string>>,list:array<map<string,int>>>"
    rows = keyed_json.entries(spark, str(path), kind).collect()
    assert len(rows) == len(data)
    found = {r["key"]: r["value"].asDict(recursive=True) for r in rows}
    assert found == data


def test_one_long_entry_over_many_ranges(spark, small_ranges, tmp_path):
    data = {"1": {"text": "x}\\{\" " * 200}, "2": {"text": "short"}, "3": {"text": "}" * 300}}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(data))
    rows = keyed_json.entries(spark, str(path), "struct<text:string>").collect()
    assert {r["key"]: {"text": r["value"]["text"]} for r in rows} == data


def test_empty_files_scalars_nulls_and_several_files(spark, small_ranges, tmp_path):
    texts = ["", " \n", "{}", '{"a": null}', '{"b": {"x": "1"}, "c": null, "d": {"x": null}, "e": null}', '{"f": {}, "b": {"x": "2"}}']
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    rows = keyed_json.entries(spark, str(tmp_path), "struct<x:string>").collect()
    found = sorted((r["key"], None if r["value"] is None else (r["value"]["x"],)) for r in rows)
    key = lambda r: (r[0], str(r[1]))
    assert sorted(found, key=key) == sorted(
        [("a", None), ("b", ("1",)), ("c", None), ("d", (None,)), ("e", None), ("f", (None,)), ("b", ("2",))], key=key
    )


def test_annotators(spark, tmp_path):
    path = tmp_path / "annotators.json"
    path.write_text(json.dumps({"Ann1": {"Age": "30", "Note": "a {b}"}, "Ann2": {}}))
    rows = items.read_annotators(spark, str(path), "CSC").collect()
    assert {r["annotator_id"]: r["attrs"] for r in rows} == {"Ann1": {"Age": "30", "Note": "a {b}"}, "Ann2": {}}


def test_no_rows_of_a_missing_object(spark, tmp_path):
    (tmp_path / "a.json").write_text("not json")
    assert keyed_json.entries(spark, str(tmp_path), "struct<x:string>").count() == 0


def test_written_files_read_back(spark, tmp_path):
    rows = [(i, "}{\"\\" * (i % 4) if i % 6 else None) for i in range(25)] + [(None, "no place")]
    df = spark.createDataFrame(rows, "key int, v string").selectExpr("key", "named_struct('v', v) AS value")
    path = str(tmp_path / "out")
    keyed_json.write(df, path, per_file=10)
    objects = [json.loads(p.read_text()) for p in sorted((tmp_path / "out").glob("file=*/part-*")) if p.stat().st_size]
    assert [len(o) for o in objects] == [10, 10, 5]
    back = keyed_json.entries(spark, f"{path}/file=*", "struct<v:string>").collect()
    assert {int(r["key"]): r["value"]["v"] for r in back} == {k: v for k, v in rows if k is not None}
    keyed_json.write(df.where("key < 0"), str(tmp_path / "none"))
