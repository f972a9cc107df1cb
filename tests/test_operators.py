"""Cleaning, votes, averages, evaluation and agreement on small tables."""

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from dissensus.functions import vectors
from dissensus.operators import (
    agreement,
    cleaning,
    distributions,
    evaluation,
    joins,
    metrics,
    reshape,
    selection,
    votes,
)
from dissensus.plans import reports

RAW = "dataset string, split string, dataset_idx bigint, run_idx int, model_id string, template_id int, gen_kwargs string, response string, success boolean"


def raw(spark, rows):
    full = [(ds, "train", i, run, "Qwen/Qwen3-32B", 31, "nonthinking", text, ok) for ds, i, run, text, ok in rows]
    return spark.createDataFrame(full, RAW)


NLI = (
    '{"entailment": {"0": 1, "1": 0}, "neutral": {"0": 0.5, "1": 0.5}, "contradiction": {"0": 0, "1": 1}}'
)


def test_clean_soft_labels(spark):
    df = raw(
        spark,
        [
            ("MP", 1, 0, " ```json\n{'0': 0.5, '1': 0.5}\n``` ", True),
            ("MP", 1, 1, '{"0": 0.5, "1": 0.6}', None),
            ("MP", 2, 0, '{"0": 1, "1": 0}', False),
            ("MP", 3, 0, None, True),
            ("MP", 4, 0, "  ", True),
            ("MP", 5, 0, "[0.5, 0.5]", True),
            ("VariErrNLI", 6, 0, NLI, True),
            ("VariErrNLI", 7, 0, '{"entailment": {"0": 1, "1": 0}}', True),
        ],
    )
    out = {(r["dataset_idx"], r["run_idx"], r["category"]): r for r in cleaning.clean(df).collect()}
    assert out[1, 0, ""]["pred"] == [0.5, 0.5] and out[1, 0, ""]["is_valid_pred"]
    assert not out[1, 1, ""]["is_valid_pred"]
    assert out[6, 0, "neutral"]["pred"] == [0.5, 0.5] and out[6, 0, "neutral"]["is_valid_pred"]
    assert not out[7, 0, "entailment"]["is_valid_pred"]
    assert {k[0] for k in out} == {1, 6, 7}
    assert out[1, 0, ""]["gen_kwargs"] == "set2" and out[1, 0, ""]["template_alias"] == "3 +def+pers"
    reasons = {(r["dataset_idx"], r["run_idx"]): r["reason"] for r in cleaning.rejected(df).collect()}
    assert reasons == {
        (1, 1): "not valid", (2, 0): "failed", (3, 0): "no response", (4, 0): "blank response",
        (5, 0): "not readable", (7, 0): "not valid",
    }


@pytest.mark.parametrize(("task", "parses"), [(cleaning.SOFT, 12), (cleaning.PERSPECTIVIST, 10)])
def test_an_answer_is_parsed_once(spark, task, parses):
    # Each of the tries of the two forms, whole and by category, once.
    plan = cleaning.clean(raw(spark, [("CSC", 1, 0, "{}", True)]), task)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("JsonToStructs(") <= parses


def test_share_of_invalid_answers_comes_from_the_same_pass(spark):
    df = raw(spark, [("MP", i, 0, '{"0": 0.5, "1": %s}' % (0.5 if i else 0.9), True) for i in range(4)])
    seen = Observation("validity")
    assert cleaning.clean(df, discard_invalid=True, observation=seen).count() == 3
    assert seen.get == {"rows": 4, "invalid": 1}


def test_clean_labels_and_steps(spark):
    df = raw(
        spark,
        [
            ("MP", 1, 0, "[1, 0, 1.0]", True),
            ("MP", 2, 0, '{"a": 1}', True),
            ("VariErrNLI", 3, 0, '{"entailment": [1], "neutral": [0], "contradiction": [0]}', True),
            ("VariErrNLI", 4, 0, '{"entailment": [1], "neutral": ["x"], "contradiction": [0]}', True),
        ],
    )
    out = {(r["dataset_idx"], r["category"]): r for r in cleaning.clean(df, cleaning.PERSPECTIVIST).collect()}
    assert out[1, ""]["pred"] == [1, 0, 1]
    assert out[2, ""]["pred"] is None and not out[2, ""]["is_valid_pred"]
    assert out[3, "entailment"]["is_valid_pred"] and not out[4, "entailment"]["is_valid_pred"]
    steps = raw(spark, [("MP", 1, 0, '{"steps": ["a"], "final_response": {"0": 0.5, "1": 0.5}}', True)])
    assert cleaning.clean(steps, with_steps=True).first()["pred"] == [0.5, 0.5]


def test_unknown_template_raises(spark):
    df = raw(spark, [("MP", 1, 0, '{"0": 1}', True)]).withColumn("template_id", F.lit(99))
    with pytest.raises(Exception, match="no alias"):
        cleaning.clean(df).collect()


def test_success_needs_room_below_the_token_limit(spark):
    df = spark.createDataFrame(
        [(1, True, 10, 9), (2, True, 10, 10), (3, False, 10, 1), (4, True, None, 1)],
        "id int, success boolean, max_tokens int, n_output_tokens int",
    )
    assert [r["id"] for r in cleaning.recompute_success(df).where("success").collect()] == [1]
    assert cleaning.recompute_success(df.drop("max_tokens")).where("success").count() == 3


@pytest.mark.parametrize("weights,expected", [(None, [0.2, 0.8]), ([0.0, 1.0], [0.3, 0.7]), ([1.0, 0.0], [0.1, 0.9])])
def test_mean_vectors(spark, weights, expected):
    rows = [(1, [0.1, 0.9], (weights or [1, 1])[0] * 1.0), (1, [0.3, 0.7], (weights or [1, 1])[1] * 1.0)]
    df = spark.createDataFrame(rows, "k int, pred array<double>, w double")
    out = distributions.mean_vectors(df, ["k"], weight=F.col("w") if weights else None).first()["pred"]
    assert out == pytest.approx(expected)
    assert sum(out) == pytest.approx(1)


def test_votes_against_the_statistics_module(spark):
    r = np.random.default_rng(0)
    data = pd.DataFrame({"dataset_idx": r.integers(0, 40, 400), "pred": r.integers(-5, 6, 400)})
    df = spark.createDataFrame(data)
    grouped = data.groupby("dataset_idx")["pred"]
    for rule, op in (("median_low", statistics.median_low), ("median_high", statistics.median_high)):
        out = {x[0]: x[1] for x in votes.vote(df, rule, ["dataset_idx"]).collect()}
        assert out == grouped.apply(lambda s, op=op: op(s.tolist())).to_dict()
    mode = {x[0]: x[1] for x in votes.vote(df, "mode", ["dataset_idx"]).collect()}
    assert mode == grouped.apply(lambda s: min(statistics.multimode(s.tolist()))).to_dict()
    assert votes.all_votes(df, ["dataset_idx"]).count() == 3 * data["dataset_idx"].nunique()


def test_majority_vote_per_position(spark):
    rows = [("MP", "dev", 1, run, [1, 0, run % 2]) for run in range(3)]
    df = spark.createDataFrame(rows, "dataset string, split string, dataset_idx bigint, run_idx int, pred array<int>")
    keys = ["dataset", "split", "dataset_idx"]
    out = votes.position_lists(votes.position_votes(df, keys, [F.col("run_idx")]), keys).first()
    assert out["pred"] == [1, 0, 0]


def test_most_frequent_baseline(spark):
    df = spark.createDataFrame(
        [("CSC", "dev", 1, {"Ann1": "1", "Ann2": "6"}), ("CSC", "dev", 2, {"Ann1": "1"}), ("CSC", "dev", 3, {"Ann1": "4"})],
        "dataset string, split string, dataset_idx bigint, annotations map<string,string>",
    )
    rows = votes.most_frequent_baseline(votes.annotation_rows(df))
    out = {r["dataset_idx"]: r["avg_abs_dist"] for r in votes.by_item(rows).collect()}
    assert out == pytest.approx({1: 0, 2: 0, 3: 3 / 6})


def test_binary_scores(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0), ("b", 0, 0)], "k string, target int, pred int")
    out = {r["k"]: r.asDict() for r in agreement.binary_scores(df, ["k"]).collect()}
    assert out["a"]["f1"] == 0.5 and out["a"]["count"] == 4
    assert out["b"]["precision"] == out["b"]["recall"] == out["b"]["f1"] == 0


def test_interval_alpha_against_all_pairs(spark):
    r = np.random.default_rng(2)
    a = r.integers(-1, 2, 60)
    b = np.where(r.random(60) < 0.7, a, r.integers(-1, 2, 60))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "a": a, "b": b}))
    got = agreement.interval_alpha(df, ["k"]).first()["alpha"]
    values = np.concatenate([a, b])
    n = len(values)
    expected = ((values[:, None] - values[None, :]) ** 2).sum() / (n * (n - 1))
    assert got == pytest.approx(1 - ((a - b) ** 2).mean() / expected)
    same = df.withColumn("a", F.lit(1)).withColumn("b", F.lit(1))
    assert agreement.interval_alpha(same, ["k"]).first()["alpha"] is None


def test_correlation_of_constants_is_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "k int, x double, y double")
    out = {r["k"]: r["corr"] for r in agreement.group_correlation(df, ["k"], "x", "y").collect()}
    assert out == {1: 0.0, 2: pytest.approx(1.0)}


def test_extremes(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.1), (2, 0, 0.3)], "k int, run_idx int, s double")
    out = {(r["k"], r["run_idx"]): r["rating"] for r in selection.extremes(df, ["k"], "s", [F.col("run_idx")]).collect()}
    assert out == {(1, 0): "in-between", (1, 1): "best", (1, 2): "worst", (2, 0): "worst"}


def test_shards_are_a_partition(spark):
    df = spark.createDataFrame([(x,) for x in range(10, 20)], "x int")
    by_place = [[r["x"] for r in selection.shard_by_position(df, [F.col("x")], k, 3).collect()] for k in range(3)]
    assert sorted(sum(by_place, [])) == list(range(10, 20)) and by_place[0] and sorted(by_place[0]) == [10, 13, 16, 19]
    by_hash = [[r["x"] for r in selection.shard(df, ["x"], k, 3).collect()] for k in range(3)]
    assert sorted(sum(by_hash, [])) == list(range(10, 20))


def test_random_subset_grows(spark):
    df = spark.range(500).withColumnRenamed("id", "dataset_idx")
    few = {r[0] for r in selection.random_items(df, 10).collect()}
    more = {r[0] for r in selection.random_items(df, 100).collect()}
    assert len(few) == 10 and few < more


def test_annotator_metadata_fallback(spark):
    items = spark.createDataFrame(
        [("MP", "dev", 1, ["Ann1", "2", "Ann3"])], "dataset string, split string, dataset_idx bigint, annotator_ids array<string>"
    )
    people = spark.createDataFrame(
        [("MP", "1", {"age": "30"}), ("MP", "2", {"age": "40"})], "dataset string, annotator_id string, attrs map<string,string>"
    )
    lists = joins.collect_metadata(joins.with_metadata(joins.annotator_rows(items), people)).first()
    assert lists["annotator_metadata"] == [{"age": "30"}, {"age": "40"}, joins.UNKNOWN_ANNOTATOR]


def test_fewshot_join_must_keep_the_rows(spark):
    schema = "dataset string, split string, dataset_idx bigint, response string"
    examples = spark.createDataFrame([("MP", "dev", 1, "a"), ("MP", "dev", 2, "b")], schema)
    out = joins.fewshot_with_solutions(examples, examples.withColumn("response", F.lit("great"))).collect()
    assert [r["response_judge"] for r in out] == ["great", "great"]
    with pytest.raises(joins.RowCountError):
        joins.fewshot_with_solutions(examples, examples.where("dataset_idx = 1"))


def test_metrics_average_over_categories(spark):
    rows = [(1, "a", [1.0, 0.0], [1.0, 0.0]), (1, "b", [1.0, 0.0], [0.0, 1.0]), (1, "c", [1.0, 0.0], [0.5, 0.5])]
    df = spark.createDataFrame(rows, "k int, category string, target array<double>, pred array<double>")
    out = metrics.per_answer(metrics.with_soft_metrics(df.withColumn("n_classes", F.lit(2))), ["k"], ["ws_loss"])
    assert out.first()["ws_loss"] == pytest.approx(0.5)


def test_oracle_is_not_worse_than_the_mean(spark, sf_dir):
    from workloads.base import Tables
    from workloads import catalogue  # noqa: F401

    t = Tables(spark, sf_dir)
    oracle = selection.oracle(t.scored, "ws_loss", ["dataset", "split", "dataset_idx"])
    a = oracle.groupBy("dataset").agg(F.avg("ws_loss").alias("best"))
    b = t.scored.groupBy("dataset").agg(F.avg("ws_loss").alias("mean"), F.max("ws_loss").alias("worst"))
    assert all(r["best"] <= r["mean"] <= r["worst"] for r in a.join(b, "dataset").collect())


def test_bundles_stack_and_filter(spark):
    schema = "dataset string, split string, dataset_idx bigint, annotator_ids string, pred int, target int"
    rows = [("MP", "dev", i, "Ann1", (i + run) % 2, i % 2) for i in range(4) for run in range(3)]
    preds = spark.createDataFrame(rows, schema)
    targets = distributions.soft_labels(preds, col="target", name="target")
    one = evaluation.evaluate(preds, targets)
    both = evaluation.stack(evaluation.with_column(one, "part", "a"), evaluation.with_column(one, "part", "b"))
    assert both["accuracy"].count() == 8
    assert evaluation.only(both, "part = 'a'")["f1"].count() == 4
    accuracy = {r["name"]: r["correct"] for r in one["accuracy"].collect()}
    assert accuracy["simple"] == pytest.approx(8 / 12) and accuracy["maj(mode)"] == 1


def test_label_baselines(spark):
    keys = "dataset string, split string, dataset_idx bigint"
    items = spark.createDataFrame([("CSC", "dev", 1, 7, "", [1, 6])], keys + ", n_classes int, category string, target array<int>")
    preds = spark.createDataFrame(
        [("m", "CSC", "dev", 1, 7, "", run, p) for run, p in enumerate([[1, 6], [1, 3], [4, 3]])],
        "model_id string, " + keys + ", n_classes int, category string, run_idx int, pred array<int>",
    )
    out = {r["method"]: r["avg_abs_dist"] for r in reports.label_baselines(preds, items).collect()}
    assert out["BoN Oracle"] == 0
    assert out["Majority Vote"] == pytest.approx(0.25)
    assert out["Simple Sampling"] == pytest.approx((0 + 0.25 + 0.5) / 3)


def test_upsampling_repeats_in_turn(spark):
    from dissensus.operators import resample

    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1)]
    out = resample.upsample(spark.createDataFrame(rows, "g string, v int"), "g", [F.col("v")])
    got = {}
    for r in out.orderBy("g", "position").collect():
        got.setdefault(r["g"], []).append(r["v"])
    assert got == {"a": [1, 2, 1], "b": [1, 2, 3], "c": [1, 1, 1]}


def test_reshape(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert reshape.named({"a": a, "b": b}).count() == 2
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("n", 3.0)], "model string, v double")
    wide = reshape.mean_pivot(df.withColumn("k", F.lit("r")), "k", "model", ["m", "n"], "v", 1).first()
    assert (wide["m"], wide["n"]) == (1.5, 3.0)
    levels = reshape.correctness_levels(
        spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "dataset_idx int, is_correct int")
    )
    rows = {r[0]: r[1] for r in reshape.correctness_level_rows(levels).collect()}
    assert rows == {1: "mixed", 2: "all_correct", 3: "all_incorrect"}


def test_vectors_sum_to_one_after_averaging(spark, sf_dir):
    from workloads.base import Tables
    from workloads import catalogue  # noqa: F401

    t = Tables(spark, sf_dir)
    assert t.averaged.where(~vectors.sums_to_one(F.col("pred"), 1e-9)).isEmpty()


def test_vectors_and_labels_of_any_length(spark):
    rows = [("a", [0.0] * 11 + [1.0] + [0.0] * 4), ("a", [0.5] + [0.0] * 10 + [0.5] + [0.0] * 4), (None, [1.0] + [0.0] * 15), ("b", None)]
    df = spark.createDataFrame(rows, "k string, pred array<double>")
    out = {r["k"]: r["pred"] for r in distributions.mean_vectors(df, ["k"]).collect()}
    assert out["a"] == [0.25] + [0.0] * 10 + [0.75] + [0.0] * 4 and out[None][0] == 1.0 and not out["b"]
    with pytest.raises(Exception, match="more than 11 classes"):
        distributions.mean_vectors(df, ["k"], width=11).collect()
    labels = spark.createDataFrame([("a", 0), ("a", 14), ("a", 14), ("a", 99), (None, 2)], "k string, x int")
    for width in (None, 16):
        got = {r["k"]: r["pred"] for r in distributions.label_shares(labels, ["k"], F.col("x"), F.lit(16), width=width).collect()}
        assert got["a"] == [1 / 3] + [0.0] * 13 + [2 / 3, 0.0] and got[None][2] == 1.0


def test_null_keys_have_quintiles_and_extremes(spark):
    from dissensus.operators import diversity, selection

    rows = [(k, i, float(i)) for k in ("a", None) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    tags = diversity.with_quintile(df, "v", by=["k"]).groupBy("k", "diversity").count().collect()
    assert sorted((str(r["k"]), r["diversity"], r["count"]) for r in tags) == [(k, f"Q{q}", 2) for k in ("None", "a") for q in range(1, 6)]
    rated = selection.extremes(df, ["k"], "v", [F.col("i")]).groupBy("k", "rating").count().collect()
    assert sorted((str(r["k"]), r["rating"], r["count"]) for r in rated) == [(k, t, n) for k in ("None", "a") for t, n in (("best", 1), ("in-between", 8), ("worst", 1))]


def test_ranks_of_a_large_group_with_a_null_key(spark):
    from dissensus.operators import ordering

    df = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', NULL) AS k", "id AS v")
    limit = ordering.SizeLimit(rows=100, share=0.0)
    found = ordering.ranked(df, ["k"], [F.col("v")], limit=limit)
    assert found.where("rank <> v div 2 + 1").count() == 0
    assert ordering.with_ranges(df, ["k"], F.struct("v"), limit).where("k IS NULL").agg(F.max("__range")).first()[0] > 5
