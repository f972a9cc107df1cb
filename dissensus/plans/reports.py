"""From raw answers to metrics, progress reports and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.operators import (
    cleaning,
    distributions,
    diversity,
    evaluation,
    joins,
    metrics,
    ordering,
    reshape,
    selection,
    votes,
)
from dissensus.schemas import EXAMPLE, ITEM
from dissensus.session import written


def answers_with_metrics(
    raw: DataFrame, items: DataFrame, task: str = cleaning.SOFT, with_steps: bool = False, discard_invalid: bool = True
) -> DataFrame:
    """Raw answers cleaned, joined to their items, with metric columns."""
    preds = cleaning.clean(raw, task, with_steps, discard_invalid)
    return metrics.with_metrics(joins.join_items(preds, items), task)


def progress(raw: DataFrame, items: DataFrame, with_steps: bool = True) -> DataFrame:
    """Validity and mean distance of the answers so far, by run settings."""
    preds = cleaning.clean(raw, with_steps=with_steps)
    keys = evaluation.REPORT_KEYS
    valid = evaluation.validity(preds, keys)
    scored = metrics.with_soft_metrics(joins.join_items(preds.where("is_valid_pred"), items))
    return evaluation.validity_and_losses(valid, evaluation.losses(scored, keys), keys)


def soft_baselines(
    preds: DataFrame, items: DataFrame, by: list[str] | None = None, tie: list[Column] | None = None
) -> DataFrame:
    """Mean distance and entropy of every way to reduce the answers of an item.

    ``preds`` are cleaned predictions, ``items`` have targets in rows of categories.
    ``tie`` orders answers of one run that are equally good. Items are written once. Where
    no item has too many answers for a task, all methods that take the answers as they are
    go over them in one pass, sorted by item.
    """
    by = by or ["dataset"]
    items = written(items, "items")
    keys = joins.item_keys(preds, items)
    n = None if "category" in preds.columns else ordering.rows_if_small(preds.select(*keys), keys)
    small = n is not None
    if small:
        preds = preds.repartition(ordering.n_tasks(preds.sparkSession, n), *keys)
    joined = metrics.with_soft_metrics(joins.join_items(preds, items))
    cols = ["ws_loss", "pred_entropy"]
    methods = {
        "Model Averaging": distributions.model_average_metrics(preds, items),
        "Most Frequent": distributions.dataset_mean_metrics(items),
        "Uniform": metrics.uniform_baseline(items),
    }
    if not small:
        methods |= {
            "Simple Sampling": joined,
            "Smoothing": distributions.smoothed_metrics(preds, items),
            "BoN Oracle": best_answers(joined, "ws_loss", tie),
        }
    means = lambda df: df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])
    found = reshape.named({k: means(v) for k, v in methods.items()}, "method").select("method", *by, *cols)
    return found.unionByName(means_in_one_pass(joined, by, cols, tie)) if small else found


def means_in_one_pass(joined: DataFrame, by: list[str], cols: list[str], tie: list[Column] | None) -> DataFrame:
    """Mean metrics of all answers, of their smoothed form, and of each item's best one."""
    marked = best_answers(joined, "ws_loss", tie, mark="__best")
    renamed = marked.withColumnsRenamed({c: f"__own_{c}" for c in cols})
    both = distributions.smoothed_metrics(renamed)
    of = {
        "Simple Sampling": {c: F.col(f"__own_{c}") for c in cols},
        "Smoothing": {c: F.col(c) for c in cols},
        "BoN Oracle": {c: F.when(F.col("__best"), F.col(f"__own_{c}")) for c in cols},
    }
    means = both.groupBy(*by).agg(
        F.max("__best").alias("__best"),
        *[F.avg(x).alias(f"__{i}_{c}") for i, parts in enumerate(of.values()) for c, x in parts.items()],
    )
    rows = [F.struct(F.lit(name).alias("method"), *[F.col(f"__{i}_{c}").alias(c) for c in cols]) for i, name in enumerate(of)]
    # A group without a known metric has no best answer.
    some = F.when(F.col("__best"), F.array(*rows)).otherwise(F.array(*rows[:2]))
    return means.select(*by, F.inline(some)).select("method", *by, *cols)


def best_answers(
    joined: DataFrame, metric: str, tie: list[Column] | None = None, mark: str | None = None
) -> DataFrame:
    """Best answer of each item, judged by the mean over its categories.

    Metrics that agree in nine decimals are equal; ties go to the first run, and
    then by the order ``tie``. ``mark`` keeps all answers, which have no categories
    then, and names a column that tells the best ones.
    """
    keys = [c for c in EXAMPLE if c in joined.columns]
    if "category" in joined.columns:
        cols = [c for c in ("ws_loss", "pred_entropy", "avg_abs_dist") if c in joined.columns]
        joined = metrics.per_answer(joined, [*keys, "run_idx"], cols)
    order = [F.round(metric, 9), *selection.tie_keys(joined), *(tie or [])]
    if mark is not None:
        order[0] = order[0].asc_nulls_last()
        marked = ordering.first_rows(joined, keys, order, mark=mark)
        return marked.withColumn(mark, F.col(mark) & F.col(metric).isNotNull())
    return ordering.first_rows(joined.where(F.col(metric).isNotNull()), keys, order)


def label_baselines(preds: DataFrame, items: DataFrame) -> DataFrame:
    """Mean annotator distance of single answers, majority vote and oracle by dataset."""
    joined = metrics.with_metrics(joins.join_items(preds, items), cleaning.PERSPECTIVIST)
    keys = [c for c in ["model_id", *ITEM, "n_classes", "category"] if c in preds.columns]
    voted = votes.position_lists(votes.position_votes(preds, keys, [F.col("run_idx")]), keys)
    majority = metrics.with_metrics(joins.join_items(voted, items), cleaning.PERSPECTIVIST)
    frames = {
        "Simple Sampling": joined,
        "Majority Vote": majority,
        "BoN Oracle": best_answers(joined, "avg_abs_dist"),
    }
    cols = ["dataset", "avg_abs_dist"]
    return (
        reshape.named({k: v.select(*cols) for k, v in frames.items()}, "method")
        .groupBy("method", "dataset")
        .agg(F.avg("avg_abs_dist").alias("avg_abs_dist"))
    )


def diversity_report(preds: DataFrame, items: DataFrame) -> DataFrame:
    """Gains of averaging and oracle by dataset and diversity quintile."""
    joined = metrics.with_soft_metrics(joins.join_items(preds, items))
    by_item = diversity.by_problem(preds, ITEM, by=["dataset"])
    average = distributions.model_average_metrics(preds, items)
    best = selection.oracle(joined, "ws_loss", ITEM)
    gains = diversity.improvements(joined, average, best, by_item)
    return diversity.captured_fraction(gains, ["dataset", "diversity"])
