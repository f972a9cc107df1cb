"""Stacking, pivoting, exploding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.operators import cleaning, ordering
from dissensus.schemas import ITEM
from dissensus.session import written


def stacked(*frames: DataFrame) -> DataFrame:
    """Frames on top of each other by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def named(frames: dict[str, DataFrame], col: str = "name") -> DataFrame:
    """Frames on top of each other, with the name of each in a column."""
    return stacked(*[df.withColumn(col, F.lit(name)) for name, df in frames.items()])


def long_form(df: DataFrame, keys: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def common_ids(a: DataFrame, b: DataFrame, key: str = "dataset_idx") -> DataFrame:
    """Ids that occur in both frames."""
    return a.select(key).intersect(b.select(key))


def exploded_labels(df: DataFrame, col: str = "pred") -> DataFrame:
    """One row per sampled label; null and forbidden labels are left out."""
    rows = df.withColumn(col, F.explode(col))
    return cleaning.drop_invalid_labels(cleaning.drop_missing(rows, col), col)


def correctness_levels(df: DataFrame, keys: list[str] | None = None, flag: str = "is_correct") -> DataFrame:
    """Correct and incorrect answers of each item, and its level."""
    right = F.col(flag).cast("int") == 1
    counts = df.groupBy(*(keys or ["dataset_idx"])).agg(
        F.count_if(~right).alias("incorrect"), F.count_if(right).alias("correct")
    )
    some_wrong, some_right = F.col("incorrect") > 0, F.col("correct") > 0
    return counts.withColumns(
        {
            "all_incorrect": some_wrong & ~some_right,
            "all_correct": ~some_wrong & some_right,
            "mixed": some_wrong & some_right,
        }
    )


def correctness_level_rows(levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The level of each item as one text column."""
    names = ["all_incorrect", "all_correct", "mixed"]
    level = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in names])
    return levels.select(*(keys or ["dataset_idx"]), level.alias("correct_level")).where(
        F.col("correct_level").isNotNull()
    )


def mean_pivot(df: DataFrame, row: str, col: str, values: list, metric: str, digits: int | None = None) -> DataFrame:
    """Mean of a metric with one row per ``row`` and one column per value of ``col``."""
    wide = df.groupBy(row).pivot(col, values).agg(F.avg(metric))
    if digits is None:
        return wide
    return wide.select(row, *[F.round(F.col(f"`{v}`"), digits).alias(str(v)) for v in values])


def model_difference(df: DataFrame, key: str, a: str, b: str, metric: str, model: str = "model_id") -> DataFrame:
    """Mean metric of two models for each item, and their difference."""
    def of(name: str):
        return F.avg(F.when(F.col(model) == name, F.col(metric)))

    return (
        df.where(F.col(model).isin(a, b))
        .groupBy(key)
        .agg(of(a).alias("a"), of(b).alias("b"))
        .withColumn("diff", F.col("a") - F.col("b"))
    )


def token_stats(df: DataFrame, keys: list[str], probs: list[float] = (0.25, 0.75)) -> DataFrame:
    """Mean, total and quartiles of input and output tokens: one row per (keys, part)."""
    parts = long_form(df, keys, ["n_input_tokens", "n_output_tokens"], "part", "n_tokens")
    group = [*keys, "part"]
    means = parts.groupBy(*group).agg(
        F.avg("n_tokens").alias("mean"), F.sum("n_tokens").alias("total")
    )
    ends = ordering.quantiles(parts, group, "n_tokens", list(probs)).groupBy(*group).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{round(p * 100)}")
            for p in probs
        ]
    )
    return means.join(ends, group)


def rater_means(df: DataFrame, key: str, cols: list[str], digits: int = 2) -> DataFrame:
    return df.groupBy(key).agg(*[F.round(F.avg(c), digits).alias(c) for c in cols])


def personas(rows: DataFrame, include_none: bool = False) -> DataFrame:
    """Annotator rows with the persona text of their prompt.

    With ``include_none`` every row also comes without a persona; each copy keeps
    the persona its own prompt is made with.
    """
    text = F.to_json("metadata", {"pretty": "true"})
    choices = [text, F.lit("none")] if include_none else [text]
    return rows.withColumn("persona", F.explode(F.array(*choices)))


def item_order(items: DataFrame, kept: bool = False) -> DataFrame:
    """Items with a position column for ordered output.

    They are written first, unless they are ``kept`` already, as sizes, bounds and places
    are read from them one by one.
    """
    items = items if kept else written(items, "items")
    return ordering.running_total(items, [], [F.col(c) for c in ITEM], name="ord")


def label_domain(df: DataFrame) -> DataFrame:
    return df.withColumn("domain", registry.domain_name(F.col("dataset")))
