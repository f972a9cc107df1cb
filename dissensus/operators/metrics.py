"""Metric columns of joined rows, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import vectors
from dissensus.operators import cleaning


def with_sums(df: DataFrame) -> DataFrame:
    """Sums of target and pred as columns, so that the metrics compute them once."""
    return df.withColumns(
        {"__st": vectors.total(F.col("target")), "__sp": vectors.total(F.col("pred"))}
    )


def wasserstein_of_sums(width: int = registry.MAX_CLASSES) -> Column:
    return vectors.wasserstein_up_to("target", "pred", "__st", "__sp", width)


def with_wasserstein(df: DataFrame, width: int = registry.MAX_CLASSES) -> DataFrame:
    return with_sums(df).withColumn("ws_loss", wasserstein_of_sums(width)).drop("__st", "__sp")


def with_soft_metrics(df: DataFrame, width: int = registry.MAX_CLASSES) -> DataFrame:
    """Wasserstein, its normed form and the entropy of each (answer, category) row."""
    df = with_sums(df).withColumns(
        {
            "ws_loss": wasserstein_of_sums(width),
            "pred_entropy": vectors.entropy_up_to("pred", "__sp", width),
        }
    )
    normed = F.col("ws_loss") / (F.col("n_classes") - 1)
    return df.withColumn("normed_ws_loss", normed).drop("__st", "__sp")


def with_l0(df: DataFrame) -> DataFrame:
    return df.withColumn("l0_loss", vectors.mean_abs_diff(F.col("target"), F.col("pred")))


def with_abs_dist(df: DataFrame) -> DataFrame:
    """Mean absolute annotator distance as a share of the label range."""
    dist = vectors.mean_abs_diff(F.col("target"), F.col("pred"))
    return df.withColumn("avg_abs_dist", dist / (F.col("n_classes") - 1))


def with_metrics(df: DataFrame, task: str = cleaning.SOFT) -> DataFrame:
    if task == cleaning.SOFT:
        return with_soft_metrics(df)
    return with_abs_dist(cleaning.same_length(df))


def with_target_columns(items: DataFrame) -> DataFrame:
    """Holes and entropy of the target of each (item, category) row."""
    holes = vectors.has_holes(F.col("target")) & ~registry.is_binary(F.col("dataset"))
    return items.withColumns(
        {"tgt_has_holes": holes, "target_entropy": vectors.entropy(F.col("target"))}
    )


def per_answer(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean of metrics over the categories of an answer; null if one is null."""
    return df.groupBy(*keys).agg(
        *[F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c) for c in cols]
    )


def n_answers() -> Column:
    """Answers in a group of (answer, category) rows."""
    return F.sum(1.0 / registry.n_categories(F.col("dataset")))


def mean_metrics(
    df: DataFrame, cols: list[str] | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Mean metrics by the report columns the frame has.

    Valid answers of a dataset all have the same number of categories, so the
    mean over rows is the mean of the answers' means and needs no inner grouping.
    """
    cols = cols or ["ws_loss", "pred_entropy"]
    keys = keys or ["model_id", "dataset", "split", "template_id", "template_alias"]
    return df.groupBy(*[c for c in keys if c in df.columns]).agg(
        *[F.avg(c).alias(c) for c in cols]
    )


def uniform_baseline(items: DataFrame) -> DataFrame:
    """Items with the uniform distribution as prediction, and its metrics."""
    n = registry.n_classes(F.col("dataset"))
    return with_soft_metrics(items.withColumn("pred", vectors.uniform(n)))


def uniform_baseline_means(items: DataFrame) -> DataFrame:
    return uniform_baseline(items).groupBy("dataset", "split").agg(F.avg("ws_loss").alias("ws_loss"))


def uniform_entropy(datasets: DataFrame) -> DataFrame:
    """Entropy of the uniform distribution of each dataset."""
    entropy = vectors.max_entropy(registry.n_classes(F.col("dataset")))
    return datasets.select("dataset").distinct().withColumn("entropy", entropy)


def mean_target_entropy(items: DataFrame) -> DataFrame:
    return items.groupBy("dataset", "n_classes").agg(
        F.avg(vectors.entropy(F.col("target"))).alias("entropy")
    )


def label_distance(df: DataFrame) -> DataFrame:
    """Whether a single label is right, and how far off it is in the label range."""
    return df.withColumns(
        {
            "correct": F.col("pred") == F.col("target"),
            "abs_dist": F.abs(F.col("pred") - F.col("target"))
            / (registry.n_classes(F.col("dataset")) - 1),
        }
    )


def class_differences(df: DataFrame, keys: list[str]) -> DataFrame:
    """Target and prediction class by class: (keys, class, target, pred, abs_diff)."""
    return df.select(
        *keys, F.posexplode(F.arrays_zip("target", "pred")).alias("class", "__pair")
    ).select(
        *keys,
        "class",
        F.col("__pair.target").alias("target"),
        F.col("__pair.pred").alias("pred"),
        F.abs(F.col("__pair.target") - F.col("__pair.pred")).alias("abs_diff"),
    )


def average_wasserstein(df: DataFrame, digits: int = 5) -> DataFrame:
    """One row: the mean distance of all rows, rounded."""
    return with_wasserstein(df).agg(F.round(F.avg("ws_loss"), digits).alias("average_ws"))
