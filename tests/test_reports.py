"""Baselines in one pass over the answers against one method at a time."""

import pytest
from pyspark.sql import functions as F

from dissensus.operators import distributions, diversity, joins, metrics, ordering
from dissensus.plans import reports


def answers(spark):
    """Repeated answers, among them equal ones, answers without an item and items without an answer."""
    of = {"CSC": 7, "MP": 2, "Paraphrase": 11}
    rows = []
    for i in range(60):
        dataset = list(of)[i % 3]
        for run in range(1 + i % 4):
            pred = [0.0] * of[dataset]
            pred[(i + run) % of[dataset]] += 0.75
            pred[(i * run) % of[dataset]] += 0.25
            rows += [(dataset, "dev" if i % 5 else None, i, run, of[dataset], f"r{run}", pred)] * (1 + (i == 7))
    preds = spark.createDataFrame(rows, "dataset string, split string, dataset_idx long, run_idx int, n_classes int, rid string, pred array<double>")
    targets = [(d, "dev" if i % 5 else None, i, of[d], [1 / of[d]] * (of[d] - 1) + [1 / of[d] if i % 6 else None]) for i, d in ((i, list(of)[i % 3]) for i in range(3, 70))]
    return preds, spark.createDataFrame(targets, "dataset string, split string, dataset_idx long, n_classes int, target array<double>")


def rows(df):
    return {(r["method"], r["dataset"]): pytest.approx((r["ws_loss"], r["pred_entropy"]), nan_ok=True) if r["ws_loss"] is not None else None for r in df.collect()}


@pytest.mark.parametrize("small", [True, False])
def test_baselines_go_over_the_answers_once(spark, monkeypatch, small):
    # answers were shuffled and joined to their items four times, items computed six times.
    if not small:
        monkeypatch.setattr(ordering, "rows_if_small", lambda *_: None)
    preds, items = answers(spark)
    found = reports.soft_baselines(preds, items, tie=[F.col("rid")])
    if small:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("WindowGroupLimit") == 0
    joined = metrics.with_soft_metrics(joins.join_items(preds, items))
    alone = {
        "Simple Sampling": joined,
        "Model Averaging": distributions.model_average_metrics(preds, items),
        "Smoothing": distributions.smoothed_metrics(preds, items),
        "BoN Oracle": reports.best_answers(joined, "ws_loss", [F.col("rid")]),
        "Most Frequent": distributions.dataset_mean_metrics(items),
        "Uniform": metrics.uniform_baseline(items),
    }
    wanted = {}
    for name, df in alone.items():
        means = df.groupBy("dataset").agg(F.avg("ws_loss").alias("ws_loss"), F.avg("pred_entropy").alias("pred_entropy"))
        wanted |= rows(means.withColumn("method", F.lit(name)))
    got = found.collect()
    assert {(r["method"], r["dataset"]) for r in got} == set(wanted)
    for r in got:
        mean = wanted[r["method"], r["dataset"]]
        assert (r["ws_loss"] is None and mean is None) or (r["ws_loss"], r["pred_entropy"]) == mean


def test_marked_rows_are_the_first_rows(spark):
    df = spark.createDataFrame([(i % 5, float(i % 3), i) for i in range(40)], "g int, v double, id int")
    order = [F.col("v"), F.col("id")]
    marked = ordering.first_rows(df, ["g"], order, 2, mark="first")
    assert marked.count() == 40
    assert sorted(r["id"] for r in marked.where("first").collect()) == sorted(r["id"] for r in ordering.first_rows(df, ["g"], order, 2).collect())


def vectors_of_groups(spark):
    """Groups of one and of several vectors: equal ones, null ones, with null shares, without a sum, empty, of two lengths."""
    groups = [
        [[0.2, 0.8]], [[0.2, 0.8], [0.6, 0.4], [0.6, 0.4]], [None], [None, [1.0, 0.0], [0.0, 1.0]], [[0.5, None], [0.1, 0.9]],
        [[0.0, 0.0], [0.3, 0.7], [0.9, 0.1]], [[], [0.5, 0.5], [0.25, 0.75]], [[]], [[1.0, 0.0], [0.2, 0.3, 0.5], [0.1, 0.1, 0.8]],
        [[0.1 * i, 1 - 0.1 * i] for i in (3, 1, 4, 1, 5, 9, 2, 6)], [[float("nan"), 1.0], [0.5, 0.5], [0.1, 0.9]],
    ]
    rows = [(i if i else None, v) for i, g in enumerate(groups) for v in g]
    return spark.createDataFrame(rows, "item int, pred array<double>")


def test_listed_vectors_have_the_distance_of_windows(spark, monkeypatch):
    # each class of each vector was a row of an aggregate and a window.
    df = vectors_of_groups(spark)
    listed = diversity.pairwise_wasserstein(df, ["item"])
    assert "Window" not in listed._jdf.queryExecution().executedPlan().toString()
    of = lambda found: {r["item"]: r["avg_pairwise_ws_loss"] for r in found.collect()}
    got = of(listed)
    monkeypatch.setattr(diversity, "LIST_ROWS", 0)
    wanted = of(diversity.pairwise_wasserstein(df, ["item"]))
    assert got.keys() == wanted.keys() and len(got) == 9
    for item, value in wanted.items():
        assert got[item] == pytest.approx(value, nan_ok=True), item


def test_vectors_are_made_once_for_their_distance(spark):
    df = vectors_of_groups(spark).withColumn("pred", F.transform("pred", lambda x: x + 0.25))
    plan = diversity.pairwise_wasserstein(df, ["item"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("0.25") == 1
