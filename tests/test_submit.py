"""Result files: all or nothing."""

import pytest
from pyspark.sql import functions as F

from dissensus.operators import ordering
from dissensus.plans import submit
from dissensus.sources import submissions


def table(spark, dataset, preds):
    rows = [(dataset, "test", i, i, p) for i, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "dataset string, split string, dataset_idx bigint, ord bigint, pred array<double>")
    return submissions.must_sum_to_one(df).withColumn("pred", F.to_json("pred"))


def names(path):
    return sorted(p.name for p in path.iterdir()) if path.exists() else []


def test_files_are_read_back_in_order(spark, tmp_path):
    tables = {("CSC", "soft-label"): table(spark, "CSC", [[0.5, 0.5], [1.0, 0.0]]), ("MP", "soft-label"): table(spark, "MP", [[0.0, 1.0]])}
    paths = submit.write_all(tables, str(tmp_path))
    assert len(paths) == 2 and "_COMMITTED" in names(tmp_path)
    assert not [n for n in names(tmp_path) if "draft" in n]
    rows = submit.read_one(spark, str(tmp_path), "CSC", "soft-label", "array<double>").collect()
    assert [(r["dataset_idx"], list(r["pred"])) for r in rows] == [(0, [0.5, 0.5]), (1, [1.0, 0.0])]
    with pytest.raises(FileExistsError):
        submit.write_all(tables, str(tmp_path))


def test_a_bad_row_in_the_last_table_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    good, bad = table(spark, "CSC", [[0.5, 0.5]]), table(spark, "MP", [[0.5, 0.5], [0.5, 0.1]])
    with pytest.raises(Exception, match="does not sum to 1"):
        submit.write_all({("CSC", "soft-label"): good, ("MP", "soft-label"): bad}, str(folder))
    assert names(folder) == []
    with pytest.raises(submissions.InvalidSubmission):
        submit.read_one(spark, str(folder), "CSC", "soft-label", "array<double>")
    # The same folder can be written once the table is right.
    submit.write_all({("CSC", "soft-label"): good}, str(folder))
    assert submit.read_one(spark, str(folder), "CSC", "soft-label", "array<double>").count() == 1


def test_empty_tables_and_none(spark, tmp_path):
    assert submit.write_all({}, str(tmp_path)) == []
    submit.write_all({("CSC", "soft-label"): table(spark, "CSC", [])}, str(tmp_path / "out"))
    assert submit.read_one(spark, str(tmp_path / "out"), "CSC", "soft-label", "array<double>").count() == 0


def label_answers(spark):
    """Two answers to a run, lists of other lengths, runs and items that are null, three categories."""
    three = '{"entailment": [1, 0], "neutral": [0, 0], "contradiction": [0, 1]}'
    rows = [
        ("CSC", 0, 0, "b", "[5, 5]"), ("CSC", 0, 0, "a", "[1, 2]"), ("CSC", 0, 1, "c", "[3, 3]"),
        ("CSC", 1, 0, "d", "[1, 2, 3]"), ("CSC", 1, 2, "f", "[4, 4]"), ("CSC", 1, 1, "e", "[2, 6]"),
        ("CSC", 2, None, "g", "[1, 1]"), ("CSC", None, 0, "h", "[1, 1]"), ("CSC", 3, 0, "i", "no list"),
        ("VariErrNLI", 0, 1, "j", three), ("VariErrNLI", 0, 0, "k", '{"entailment": [1], "neutral": [0, 0], "contradiction": [0, 1]}'),
    ]
    schema = "split string, dataset string, dataset_idx long, run_idx int, rid string, response string"
    raw = spark.createDataFrame([("test", *r) for r in rows], schema)
    raw = raw.select(
        "*", F.lit(True).alias("success"), F.lit("m").alias("model_id"),
        F.lit(33).alias("template_id"), F.lit("set2").alias("gen_kwargs"),
    )
    items = [("VariErrNLI", "test", 0), *[("CSC", "test", i) for i in (3, 2, 1, 0)]]
    items = spark.createDataFrame(items, "dataset string, split string, dataset_idx long")
    return raw, items.select("*", F.array(F.lit("x"), F.lit("y")).alias("annotator_ids"))


FITTING = [("CSC", 0, "[1,2]"), ("CSC", 1, "[2,6]"), ("CSC", 2, None), ("CSC", 3, None), ("VariErrNLI", 0, "[[0,1],[1,0],[0,0]]")]


@pytest.mark.parametrize("small", [True, False])
def test_answers_are_parsed_and_shuffled_once(spark, monkeypatch, small):
    # answers were parsed twice, shuffled eight times, and joined once more to sample their order.
    if not small:
        monkeypatch.setattr(ordering, "rows_if_small", lambda *_: None)
    raw, items = label_answers(spark)
    found = submit.perspectivist_table(raw, items, [F.col("rid")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == 1 and "rangepartitioning" not in plan
    if small:
        assert plan.count("REPARTITION_BY_NUM") == 2 and "run_idx" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
    assert [(r["dataset"], r["dataset_idx"], r["pred"]) for r in found.collect()] == FITTING


def test_places_are_ranges_in_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PLACES", 10)
    df = spark.createDataFrame([((i * 7) % 100,) for i in range(100)], "ord long")
    parts = ordering.in_places(df, "ord", 100).select("ord", F.spark_partition_id().alias("p")).collect()
    assert [r["ord"] for r in parts] == list(range(100)) and len({r["p"] for r in parts}) > 2


def test_groups_are_bounded_by_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(i % 50, None if i % 3 else "x") for i in range(1000)], "k int, s string")
    n, most = ordering.bucket_stats(df, ["k", "s"])
    assert n == 1000 and most >= ordering.group_stats(df, ["k", "s"])[2]
    monkeypatch.setattr(ordering, "BUCKETS", 1)  # too few: keys are counted one by one
    assert ordering.rows_if_small(df, ["k", "s"], ordering.SizeLimit(100, 0.0)) == 1000
    assert ordering.rows_if_small(df, ["s"], ordering.SizeLimit(100, 0.0)) is None
