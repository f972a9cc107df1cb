"""Ranks, totals and quantiles with groups above and below the size limit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dissensus.operators import distributions, diversity, evaluation, ordering, reshape
from dissensus.operators.ordering import SizeLimit

SMALL = SizeLimit(rows=50, share=1e-3)


@pytest.fixture(scope="module")
def skewed():
    """One group holds a third of the rows; many values are equal."""
    r = np.random.default_rng(3)
    n = 3000
    group = np.where(r.random(n) < 1 / 3, "hot", r.integers(0, 200, n).astype(str))
    return pd.DataFrame(
        {"g": group, "v": np.round(r.random(n) ** 3, 2), "id": np.arange(n), "w": r.integers(1, 5, n)}
    )


@pytest.mark.parametrize("limit", [ordering.DEFAULT_LIMIT, SMALL], ids=["plain", "ranges"])
def test_running_total(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    out = ordering.running_total(
        df, ["g"], [F.col("v"), F.col("id")], F.col("w"), "before", "total", limit
    ).toPandas().set_index("id")
    expected = skewed.sort_values(["g", "v", "id"])
    expected["before"] = expected.groupby("g")["w"].cumsum() - expected["w"]
    expected["total"] = expected.groupby("g")["w"].transform("sum")
    expected = expected.set_index("id")
    assert len(out) == len(skewed)
    assert (out["before"].sort_index() == expected["before"].sort_index()).all()
    assert (out["total"].sort_index() == expected["total"].sort_index()).all()


def test_large_groups_are_cut(spark, skewed):
    df = spark.createDataFrame(skewed)
    ranged = ordering.with_ranges(df, ["g"], F.struct("v", "id"), SMALL)
    sizes = ranged.where("g = 'hot'").groupBy("__range").count().toPandas()["count"]
    assert 5 < len(sizes) < 60 and sizes.max() < 250
    assert ranged.where("g <> 'hot'").select("__range").distinct().collect() == [(0,)]
    assert ordering.with_ranges(df, ["g"], F.struct("v", "id"), ordering.DEFAULT_LIMIT) is None


def test_cheap_bound_skips_the_exact_check(spark, skewed):
    df = spark.createDataFrame(skewed)
    bound = df.where("g <> 'hot'").select("g")
    assert ordering.large_groups(df, ["g"], SMALL, bound) is None
    assert ordering.large_groups(df, ["g"], SMALL, df.select("g")) is not None


@pytest.mark.parametrize("limit", [ordering.DEFAULT_LIMIT, SMALL], ids=["plain", "ranges"])
def test_rank_over_all_rows(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    out = ordering.ranked(df, [], [F.col("v"), F.col("id")], limit=limit).toPandas()
    out = out.sort_values(["v", "id"])
    assert out["rank"].tolist() == list(range(1, len(skewed) + 1))


@pytest.mark.parametrize("limit", [ordering.DEFAULT_LIMIT, SMALL], ids=["plain", "ranges"])
def test_quantiles(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    out = ordering.quantiles(df, ["g"], "v", probs, limit).toPandas()
    for _, row in out.iterrows():
        values = skewed.loc[skewed["g"] == row["g"], "v"]
        assert row["quantile"] == pytest.approx(np.quantile(values, row["prob"]))
    assert len(out) == skewed["g"].nunique() * len(probs)
    whole = ordering.quantiles(df, [], "v", probs, limit).toPandas().set_index("prob")["quantile"]
    for p in probs:
        assert whole[p] == pytest.approx(np.quantile(skewed["v"], p))


def test_first_rows(spark, skewed):
    df = spark.createDataFrame(skewed)
    out = ordering.first_rows(df, ["g"], [F.col("v"), F.col("id")], 2).toPandas()
    expected = skewed.sort_values(["v", "id"]).groupby("g").head(2)
    assert set(out["id"]) == set(expected["id"])
    many = ordering.first_rows(df, [], [F.col("id")], 1500).toPandas()
    assert set(many["id"]) == set(range(1500))


def test_first_rows_are_trimmed_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed)
    plan = ordering.first_rows(df, ["g"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limit", [ordering.DEFAULT_LIMIT, SizeLimit(rows=20, share=1e-3)])
def test_pairwise_distance_equals_the_pair_loop(spark, limit):
    import itertools

    r = np.random.default_rng(5)
    rows = []
    for item in range(6):
        for _ in range(1 if item == 0 else 4 + 30 * (item == 3)):
            p = np.round(r.random(4), 1) + 0.1
            rows.append((item, (p / p.sum()).tolist()))
    df = spark.createDataFrame(rows, "item int, pred array<double>")
    out = {x["item"]: x["avg_pairwise_ws_loss"] for x in diversity.pairwise_wasserstein(df, ["item"], limit).collect()}
    for item in range(6):
        vs = [np.cumsum(p) for i, p in rows if i == item]
        ds = [np.abs(a - b).sum() for a, b in itertools.combinations(vs, 2)]
        assert out[item] == pytest.approx(np.mean(ds) if ds else 0.0)


def test_quintiles_include_their_upper_edge(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5]], "avg_pairwise_ws_loss double")
    out = {x[0]: x[1] for x in diversity.with_quintile(df).collect()}
    cut = pd.qcut(pd.Series(sorted(out)), 5, labels=["Q1", "Q2", "Q3", "Q4", "Q5"])
    assert [out[x] for x in sorted(out)] == cut.tolist()


def test_requests_number_a_large_group_in_ranges(spark, monkeypatch):
    from dissensus.operators import batches, ordering

    items = spark.createDataFrame([("d", "s", i // 2, f"t{i // 2}") for i in range(120)], "dataset string, split string, dataset_idx long, text string")
    templates = spark.createDataFrame([("d", 31, "Rate: {text}")], "dataset string, template_id int, template string")
    rows = lambda: sorted((r["dataset_idx"], r["prompt"]) for r in batches.prediction_requests(items, templates, n_examples=50).collect())
    one_window = rows()
    monkeypatch.setattr(batches, "TEXT_LIMIT", ordering.SizeLimit(rows=20))
    assert rows() == one_window and len(one_window) == 50


def exchanges(df):
    """Exchanges by hash in a plan, before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def votes_frame(spark):
    rows = [("CSC", "train", i // 4, i % 4, 7, [0.0, 0.25, 0.75, 0.0, 0.0, 0.0, 0.0], 1 + i % 6) for i in range(40)]
    schema = "dataset string, split string, dataset_idx bigint, run_idx int, n_classes int, pred array<double>, label int"
    return spark.createDataFrame(rows, schema)


def test_points_of_a_vector_are_not_shuffled(spark):
    # it was an exchange of a row per class and two more.
    found = diversity.pairwise_wasserstein(votes_frame(spark))
    assert len(exchanges(found)) == 1
    assert [r["avg_pairwise_ws_loss"] for r in found.collect()] == [0.0] * 10


def test_large_groups_are_not_dealt_to_one_task(spark):
    df = votes_frame(spark)
    assert exchanges(ordering.together(df, ["dataset"], limit=SizeLimit(10, 0.1))) == []
    assert len(exchanges(ordering.together(df, ["dataset"]))) == 1


def test_tasks_follow_the_rows_of_soft_labels(spark, monkeypatch):
    # the number of tasks did not depend on the rows.
    monkeypatch.setattr(ordering, "TASK_ROWS", 3)
    preds = votes_frame(spark).select("dataset", "split", "dataset_idx", F.col("label").alias("pred"))
    targets = distributions.soft_labels(preds, name="target")
    found = evaluation.soft_label_rows(preds, targets)
    assert any("dataset_idx" in line and ", 14)" in line for line in exchanges(found))
    assert [r["ws_loss"] for r in found.collect()] == [0.0] * 10


def test_items_are_read_once_for_their_order(spark):
    # sizes, bounds and places each computed the items.
    items = votes_frame(spark).select("dataset", "split", "dataset_idx").distinct()
    found = reshape.item_order(items)
    assert found.inputFiles()
    assert sorted(r["ord"] for r in found.collect()) == list(range(10))
