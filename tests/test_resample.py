"""Bootstrap and repeated draws against closed forms and loops."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dissensus.functions import rng
from dissensus.operators import evaluation, resample
from dissensus.schemas import ITEM


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(0)
    data = pd.DataFrame({"g": "a", "id": np.arange(800), "x": r.gamma(1.0, 1.0, 800)})
    return data, spark.createDataFrame(data)


@pytest.mark.parametrize("method", ["percentile", "basic", "BCa"])
def test_interval_agrees_with_the_normal_one(values, method):
    data, df = values
    row = resample.bootstrap_mean(df, ["g"], "x", [F.col("id")], n_resamples=2000, method=method).first()
    error = data["x"].std() / np.sqrt(len(data))
    assert row["mean"] == pytest.approx(data["x"].mean())
    assert row["low"] == pytest.approx(data["x"].mean() - 1.96 * error, abs=0.5 * error)
    assert row["high"] == pytest.approx(data["x"].mean() + 1.96 * error, abs=0.5 * error)
    assert row["n_samples"] == 800 and row["confidence_level"] == 0.95


def test_bca_shifts_towards_the_long_tail(spark):
    x = np.random.default_rng(3).gamma(0.3, 1.0, 40)
    df = spark.createDataFrame(pd.DataFrame({"id": range(40), "x": x}))
    plain = resample.bootstrap_mean(df, [], "x", [F.col("id")], 2000, "percentile").first()
    bca = resample.bootstrap_mean(df, [], "x", [F.col("id")], 2000, "BCa").first()
    assert bca["high"] > plain["high"] and bca["low"] > plain["low"]


def test_constant_group_and_no_keys(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(20)], "id int, x double")
    for method in ("percentile", "basic", "BCa"):
        row = resample.bootstrap_mean(df, [], "x", [F.col("id")], 100, method).first()
        assert (row["low"], row["mean"], row["high"]) == pytest.approx((2.0, 2.0, 2.0))


def test_result_does_not_depend_on_partitions(values):
    _, df = values
    one = resample.bootstrap_mean(df.repartition(1), ["g"], "x", [F.col("id")], 50, "basic").first()
    many = resample.bootstrap_mean(df.repartition(7), ["g"], "x", [F.col("id")], 50, "basic").first()
    assert one["low"] == pytest.approx(many["low"]) and one["high"] == pytest.approx(many["high"])


def test_weights_come_from_the_digits_in_many_tasks(spark):
    ends = [int(t * 2**32) + d for t in rng.poisson_thresholds() for d in (-1, 0, 1)] + [0, 2**32 - 1]
    words = spark.createDataFrame([(f"{b:08x}" + "0" * 24,) for b in ends if 0 <= b < 2**32], "digest string")
    got = words.select(rng.poisson(rng.word(F.col("digest"), F.lit(0))).alias("a"), rng.poisson_of_word(F.substring("digest", 1, 8)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and {r["b"] for r in got} >= {0, 1, 2, 3, 10}
    df = spark.range(100).select("id", F.lit(1.0).alias("x")).coalesce(1)
    plan = resample.replicate_sums(df, [], "x", [F.col("id")], 8, "0")._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "RepartitionByExpression [__key" in plan


def test_groups_of_any_size_have_an_interval(values):
    _, df = values
    for rows in (df, df.limit(20)):
        found = resample.cautious_mean(rows, ["g"], "x", [F.col("id")], n_resamples=50).first()
        assert found["low"] < found["mean"] < found["high"]


@pytest.fixture(scope="module")
def runs(spark):
    r = np.random.default_rng(1)
    rows = [("MP", "dev", i, run, float(r.random()), float(r.random())) for i in range(30) for run in range(2 + i % 5)]
    data = pd.DataFrame(rows, columns=[*ITEM, "run_idx", "score", "loss"])
    return data, spark.createDataFrame(data)


def test_simple_sampling_takes_one_run_of_every_item(runs):
    data, df = runs
    marked = df.withColumn("one", F.lit(1.0))
    out = resample.simple_sampling(marked, ["dataset"], ITEM, [F.col("run_idx")], "loss", k=200).toPandas()
    assert len(out) == 200
    assert out["loss"].mean() == pytest.approx(data.groupby("dataset_idx")["loss"].mean().mean(), abs=0.02)
    count = resample.simple_sampling(marked, ["dataset"], ITEM, [F.col("run_idx")], "one", k=5).toPandas()
    assert (count["one"] == 1).all()


def test_expected_best_of_n_equals_all_subsets(runs):
    data, df = runs
    out = resample.expected_best_of_n(df, ["dataset_idx"], [F.col("run_idx")], "loss", [1, 2, 3, 9]).toPandas()
    got = out.set_index("n_samples")["loss"]
    for n in (1, 2, 3, 9):
        means = []
        for _, g in data.groupby("dataset_idx"):
            rows = list(zip(g["score"], g["loss"]))
            best = [max(c)[1] for c in itertools.combinations(rows, min(n, len(rows)))]
            means.append(np.mean(best))
        assert got[n] == pytest.approx(np.mean(means))


def test_best_of_n_draws_approach_the_exact_mean(runs):
    _, df = runs
    draws = resample.best_of_n(df, ITEM, [F.col("run_idx")], "loss", n_samples=2, k=200).toPandas()
    exact = resample.expected_best_of_n(df, ["dataset_idx"], [F.col("run_idx")], "loss", [2]).first()["loss"]
    assert len(draws) == 200 and draws["loss"].mean() == pytest.approx(exact, abs=0.02)


def test_random_ties(spark):
    df = spark.createDataFrame([(1, r, 1.0 if r < 2 else 0.0, float(r)) for r in range(4)], "item int, run int, score double, v double")
    out = resample.best_with_random_ties(df, [], ["item"], [F.col("run")], "v", 100).toPandas()
    assert set(out["v"]) == {0.0, 1.0} and 0.3 < out["v"].mean() < 0.7


def test_random_ties_in_place_are_those_of_rows(spark):
    nan, none = float("nan"), None
    scores = [1.0, 1.0, 0.0, none, nan, nan, none, none, -0.0, 0.0]
    rows = [(i // 2 if i else none, r, scores[(3 * i + r * r) % 10], float(r) if r % 4 else none) for i in range(40) for r in range(6 * (i % 2), 6 * (i % 2) + 6)]
    df = spark.createDataFrame(rows, "item int, run int, score double, v double")
    def drawn(bound):
        return resample.best_with_random_ties(df, [], ["item"], [F.col("run")], "v", 20, bound=bound)
    same = lambda a, b: {r["draw"]: pytest.approx(r["v"]) for r in a.collect()} == {r["draw"]: r["v"] for r in b.collect()}
    assert same(drawn(None), drawn(df))
    best = lambda bound: resample.best_of_n(df.where("score > -1"), ["item"], [F.col("run")], "v", 2, 5, bound=bound)
    assert same(best(None), best(df))
    # Draws are made behind the exchange of the rows.
    for plan in (p._jdf.queryExecution().optimizedPlan().toString() for p in (drawn(df), best(df))):
        assert plan.index("RepartitionByExpression [item") > plan.index("Aggregate [item")


def test_single_runs_are_drawn_without_a_hash(spark):
    df = spark.createDataFrame([("a", i, r, float(i + r)) for i in range(30) for r in range(1 + i % 3)], "d string, i int, r int, score double")
    for draws in (
        resample.simple_sampling(df, ["d"], ["i"], [F.col("r")], "score", k=4),
        resample.best_of_n_by_rank(df, ["d"], ["i"], [F.col("r")], "score", 2, 4),
    ):
        assert draws.count() == 4 and "CASE WHEN" in draws._jdf.queryExecution().optimizedPlan().toString().split("filter(")[0].split("explode(")[-1]


def test_rating_matrix_in_place_is_that_of_rows(spark):
    words = ["great", "ok", "bad", "odd"]
    rated = [(i // 3, i, f'[{{"rating": "{words[i % 4]}"}}, {{"rating": "{words[i // 4 % 3]}"}}]', i % 2) for i in range(90)]
    df = spark.createDataFrame(rated, "item int, rid int, response string, is_correct int")
    def found(bound):
        out = evaluation.rating_matrix(df, ["item"], ["rid"], draws=5, n_resamples=40, method="percentile", bound=bound)
        return sorted((r["mapping"], r["operation"], *(round(r[c], 9) for c in ("low", "mean", "high", "n_samples"))) for r in out.collect())
    assert found(None) == found(df) and len(found(df)) == 6


def test_growing_subsets_contain_each_other(runs):
    _, df = runs
    out = resample.growing_subsets(df, "dataset_idx", "loss", [5, 10, 1000]).toPandas()
    groups = {n: set(g["dataset_idx"]) for n, g in out.groupby("size")}
    assert len(groups[5]) == 5 and groups[5] < groups[10] < groups[1000] and len(groups[1000]) == 30


def test_better_share_counts_subsets(spark):
    rows = [(r, n, m) for n in range(1, 7) for m in range(1, n + 1) for r in range(n + 1)]
    df = spark.createDataFrame(rows, "r long, n long, m long").select("*", resample.better_share(F.col("r"), F.col("n"), F.col("m")).alias("p"))
    for r in df.collect():
        subsets = list(itertools.combinations(range(r["n"]), r["m"]))
        assert r["p"] == pytest.approx(sum(min(c) >= r["r"] for c in subsets) / len(subsets))


def test_best_of_n_by_rank_approaches_the_exact_mean(runs):
    data, df = runs
    for n in (1, 2, 3, 50):
        draws = resample.best_of_n_by_rank(df, ["dataset"], ITEM, [F.col("run_idx")], "loss", n, k=300).toPandas()
        exact = resample.expected_best_of_n(df, ["dataset_idx"], [F.col("run_idx")], "loss", [n]).first()["loss"]
        assert len(draws) == 300 and draws["loss"].mean() == pytest.approx(exact, abs=0.02)
    best = data.loc[data.groupby("dataset_idx")["score"].idxmax(), "loss"].mean()
    assert draws["loss"].tolist() == pytest.approx([best] * 300)


def test_best_of_n_by_rank_multiplies_no_row_before_an_exchange(runs):
    _, df = runs
    out = resample.best_of_n_by_rank(df, ["dataset"], ITEM, [F.col("run_idx")], "loss", 2, k=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = min(i for i, line in enumerate(lines) if "Generate" in line)
    assert sum("Exchange" in line for line in lines[:at]) == 1  # the one of the averages, after partial sums
    assert not any("Generate" in line for line in lines[at + 1 :])


def test_every_item_has_one_best_run_in_every_draw(runs):
    _, df = runs
    marked = df.withColumn("one", F.lit(1.0)).withColumn("item", F.col("dataset_idx"))
    out = resample.best_of_n_by_rank(marked, ["item"], ITEM, [F.col("run_idx")], "one", 3, k=20)
    assert out.count() == 30 * 20 and out.agg(F.min("one"), F.max("one")).first()[:] == (1.0, 1.0)


def test_poisson_counts_of_any_mean(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    for mean in (1, 2, 7, 12, 1000):
        w = u.select(resample.poisson_of(F.lit(float(mean)), F.col("u")).alias("w"))
        found = w.agg(F.avg("w"), F.var_pop("w"), F.min("w")).first()
        assert found[0] == pytest.approx(mean, rel=0.005) and found[1] == pytest.approx(mean, rel=0.03) and found[2] >= 0


def test_counted_bootstrap_agrees_with_that_of_rows(spark):
    rows = [("a", int(i % 5 == 0)) for i in range(900)] + [("b", 1)] * 7 + [("c", None), (None, 1), (None, 0)]
    df = spark.createDataFrame(rows, "g string, x int")
    for method in ("percentile", "basic"):
        found = {r["g"]: r for r in resample.counted_bootstrap(df, ["g"], "x", 1500, method).collect()}
        assert set(found) == {"a", "b", None} and found["a"]["n_samples"] == 900
        error = np.sqrt(0.2 * 0.8 / 900)
        assert found["a"]["low"] == pytest.approx(0.2 - 1.96 * error, abs=0.3 * error)
        assert found["a"]["high"] == pytest.approx(0.2 + 1.96 * error, abs=0.3 * error)
        assert (found["b"]["low"], found["b"]["mean"], found["b"]["high"]) == (1, 1, 1)


def test_growing_means_have_the_interval_of_each_subset(runs):
    data, df = runs
    found = {r["size"]: r for r in resample.growing_means(df, "dataset_idx", "loss", [5, 12, 1000], n_resamples=200).collect()}
    sized = resample.growing_subsets(df, "dataset_idx", "loss", [5, 12, 1000])
    for size in (5, 12, 1000):
        one = resample.bootstrap_mean(sized.where(F.col("size") == size), [], "loss", [F.col("dataset_idx")], 200, "percentile").first()
        assert found[size]["n_samples"] == one["n_samples"]
        assert [found[size][c] for c in ("low", "mean", "high")] == pytest.approx([one[c] for c in ("low", "mean", "high")])


def test_draw_intervals(spark):
    draws = spark.createDataFrame([("a", i, float(i)) for i in range(41)], "g string, draw int, v double")
    assert resample.draw_intervals(draws, ["g"], "v").first()[1:] == pytest.approx((1.0, 20.0, 39.0, 41))
