"""Agreement and correlation, from sums that one pass collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.operators import resample


def correlation(x: Column, y: Column) -> Column:
    """Correlation of a group; null where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def group_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation within each group, 0 where it is not defined."""
    return df.groupBy(*keys).agg(
        F.coalesce(correlation(F.col(x), F.col(y)), F.lit(0.0)).alias("corr")
    )


def group_correlation_interval(df: DataFrame, keys: list[str], x: str, y: str, **bootstrap) -> DataFrame:
    """Mean of the groups' correlations with a bootstrap interval over the groups."""
    found = group_correlation(df, keys, x, y)
    return resample.bootstrap_mean(found, [], "corr", [F.col(k) for k in keys], **bootstrap)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations of all columns, as rows of (a, b, corr)."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}/{b}") for a, b in pairs])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}/{b}`").alias("corr"))
                    for a, b in pairs
                ]
            )
        )
    )


def rating_pairs(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Aligned rating lists as rows of (keys, pos, a, b)."""
    return df.select(
        *(keys or []), F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("pos", "__r")
    ).select(*(keys or []), "pos", F.col("__r.a").alias("a"), F.col("__r.b").alias("b"))


def equal_share(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n")
    )


def pair_counts(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def interval_alpha(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Krippendorff's alpha of two raters for interval data.

    Observed disagreement is the mean squared difference of the pairs. Expected
    disagreement is the mean squared difference of all values, which follows from
    their sum and their sum of squares: ``(2 n Q - 2 S^2) / (n (n - 1))`` for the
    ``n = 2m`` values of ``m`` pairs. Values are shifted by their mean first.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    pairs = df.where(x.isNotNull() & y.isNotNull())
    m = F.count(F.lit(1))
    observed = F.avg((x - y) * (x - y))
    # Sum of squares around the common mean, from the moments of the two sides.
    half_gap = (F.avg(x) - F.avg(y)) / 2
    squares = m * (F.var_pop(x) + F.var_pop(y) + 2 * half_gap * half_gap)
    expected = 2 * squares / (2 * m - 1)
    alpha = F.when(expected == 0, F.lit(None).cast("double")).otherwise(
        1 - F.try_divide(observed, expected)
    )
    return pairs.groupBy(*keys).agg(alpha.alias("alpha"), m.alias("n"))


def binary_scores(df: DataFrame, keys: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 of label 1, 0 where the denominator is 0."""
    t, p = F.col(target) == 1, F.col(pred) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(p).alias("pp"),
        F.count_if(t).alias("ap"),
        F.count(F.lit(1)).alias("count"),
    )
    zero = F.lit(0.0)
    return counts.select(
        *keys,
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("pp") + F.col("ap")), zero).alias("f1"),
        F.coalesce(F.try_divide("tp", "pp"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "ap"), zero).alias("recall"),
        "count",
    )


def step_count_equality(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Share of rows with the same number of steps; a missing number is unequal."""
    same = F.coalesce((a == b).cast("int"), F.lit(0))
    return df.agg(F.avg(same).alias("fraction_equal"), F.count(F.lit(1)).alias("n"))
