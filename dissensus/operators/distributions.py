"""Label distributions of groups: from labels, and as means of distributions.

A vector is built from one conditional sum per class, so a group is a single
row of a hash aggregate with partial sums on the map side. No list of the group's
values is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import vectors
from dissensus.operators import joins, metrics
from dissensus.schemas import EXAMPLE, ITEM


def label_shares(
    df: DataFrame,
    keys: list[str],
    index: Column,
    n: Column,
    name: str = "pred",
    width: int | None = None,
) -> DataFrame:
    """Share of each class among the rows of a group; ``n`` depends on the keys only.

    Labels outside 0..n-1 count in no class and not in the whole. ``width`` is the
    largest number of classes that occurs, if that is known: then a group is one row of
    an aggregate, and more classes are an error. Without it classes are counted as rows.
    """
    rows = df.withColumns({"__i": index, "__classes": n})
    inside = "(__i >= 0 AND __i < __classes)"
    if width is None:
        counted = rows.groupBy(*keys, "__i", "__classes").agg(F.count(F.lit(1)).alias("__c"))
        # As many entries as classes.
        entry = F.when(F.expr(inside), F.struct("__i", "__c"))
        grouped = counted.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(entry)).alias("__m"),
            F.sum(F.when(F.expr(inside), F.col("__c"))).alias("__n"),
            F.max("__classes").alias("__k"),
        )
        share = "transform(sequence(0, CAST(__k AS INT) - 1), i -> coalesce(try_element_at(__m, i), 0) / __n)"
        return grouped.select(*keys, F.expr(f"if(__k > 0, {share}, NULL)").alias(name))
    counts = [F.expr(f"count_if({inside} AND __i = {k})").alias(f"__c{k}") for k in range(width)]
    grouped = rows.groupBy(*keys).agg(
        *counts, F.expr(f"nullif(count_if({inside}), 0)").alias("__n"), F.first("__classes").alias("__k")
    )
    shares = ", ".join(f"__c{k} / __n" for k in range(width))
    return grouped.select(*keys, fitting(F.expr(f"slice(array({shares}), 1, __k)"), width).alias(name))


def fitting(vector: Column, width: int) -> Column:
    """The vector; an error where ``__k``, its length, is above ``width``."""
    told = F.raise_error(F.lit(f"more than {width} classes")).cast("array<double>")
    return F.when(F.col("__k") > width, told).otherwise(vector)


def soft_labels(df: DataFrame, keys: list[str] | None = None, col: str = "pred", name: str = "pred") -> DataFrame:
    """Integer labels of an item as a distribution over its dataset's classes."""
    dataset = F.col("dataset")
    return label_shares(
        df,
        keys or ITEM,
        registry.class_index(dataset, F.col(col).cast("int")),
        registry.n_classes(dataset),
        name,
        registry.MAX_CLASSES,
    )


def mean_vectors(
    df: DataFrame,
    keys: list[str],
    col: str = "pred",
    weight: Column | None = None,
    width: int | None = None,
    renormalise: bool = True,
) -> DataFrame:
    """Weighted mean of the vectors of a group, scaled to sum to 1.

    ``width`` is the largest length that occurs, if that is known: then a group is one
    row of an aggregate, and longer vectors are an error. Without it the vectors are
    added up as rows of (keys, class).
    """
    w = F.lit(1.0) if weight is None else weight
    if width is None:
        rows = df.select(*keys, w.alias("__w"), F.posexplode_outer(col).alias("__i", "__x"))
        sums = rows.groupBy(*keys, "__i").agg(F.expr("sum(__w * __x)").alias("__s"), F.sum("__w").alias("__w"))
        # As many entries as classes; the first class has the weight of all vectors.
        entry = F.when(F.col("__i").isNotNull(), F.struct("__i", "__s"))
        whole = F.sum(F.when(F.coalesce("__i", F.lit(0)) == 0, F.col("__w")))
        grouped = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__v"), whole.alias("__w"))
        mean = F.transform("__v", lambda x: F.try_divide(x["__s"], F.col("__w")))
        return grouped.select(*keys, (vectors.normalised(mean) if renormalise else mean).alias(col))
    sums = [F.expr(f"sum(__w * get(`{col}`, {k}))").alias(f"__s{k}") for k in range(width)]
    grouped = df.withColumn("__w", w).groupBy(*keys).agg(
        *sums, F.sum("__w").alias("__w"), F.max(F.size(col)).alias("__k")
    )
    means = ", ".join(f"try_divide(__s{k}, __w)" for k in range(width))
    mean = fitting(F.expr(f"slice(array({means}), 1, __k)"), width)
    return grouped.select(*keys, (vectors.normalised(mean) if renormalise else mean).alias(col))


def mean_vectors_long(df: DataFrame, keys: list[str], col: str = "pred") -> DataFrame:
    """Mean of vectors of any length, in rows of (keys, class, pred)."""
    return (
        df.select(*keys, F.posexplode(col).alias("class", "__x"))
        .groupBy(*keys, "class")
        .agg(F.avg("__x").alias(col))
    )


def example_keys(df: DataFrame) -> list[str]:
    return [c for c in [*EXAMPLE, "category"] if c in df.columns]


def model_average(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Mean distribution of the repeated answers to an item."""
    return mean_vectors(df, example_keys(df), weight=weight, width=registry.MAX_CLASSES)


def model_average_metrics(df: DataFrame, items: DataFrame) -> DataFrame:
    return metrics.with_soft_metrics(joins.join_items(model_average(df), items))


def smoothed(df: DataFrame) -> DataFrame:
    """Predictions mixed half and half with the uniform distribution."""
    return df.withColumn("pred", vectors.smoothed(F.col("pred")))


def smoothed_metrics(df: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Metrics of the smoothed predictions; one that is no distribution raises.

    Without ``items`` the predictions are joined to their items already.
    """
    checked = F.when(vectors.sums_to_one(F.col("pred")), F.col("pred")).otherwise(
        F.raise_error(F.lit("smoothed prediction does not sum to 1")).cast("array<double>")
    )
    df = smoothed(df).withColumn("pred", checked)
    return metrics.with_soft_metrics(df if items is None else joins.join_items(df, items))


def dataset_mean(items: DataFrame) -> DataFrame:
    """Mean target vector of each known dataset (and category).

    The result has at most one row per dataset and category of the registry.
    """
    known = items.where(F.col("dataset").isin(list(registry.SCHEMES)))
    keys = ["dataset"]
    if "category" in items.columns:
        categories = sorted({c for s in registry.SCHEMES.values() for c in s.categories})
        known, keys = known.where(F.col("category").isin(categories)), ["dataset", "category"]
    return mean_vectors(known.withColumn("pred", F.col("target")), keys, width=registry.MAX_CLASSES, renormalise=False)


def dataset_mean_metrics(items: DataFrame) -> DataFrame:
    """Metrics of predicting the dataset's mean target for every item."""
    keys = [c for c in ("dataset", "category") if c in items.columns]
    means = F.broadcast(dataset_mean(items))
    return metrics.with_soft_metrics(items.join(means, keys, "inner"))


def random_labels(annotators: DataFrame, seed: str = "0") -> DataFrame:
    """A random allowed label for each annotator row, from the hash of its key."""
    from dissensus.functions import rng

    dataset = F.col("dataset")
    first = registry.lookup(dataset, {n: s.first for n, s in registry.SCHEMES.items()})
    last = registry.lookup(dataset, {n: s.last for n, s in registry.SCHEMES.items()})
    keys = [F.col(c) for c in [*ITEM, "category", "annotator_id"] if c in annotators.columns]
    return annotators.withColumn("pred", rng.integer(first, last, F.lit(seed), *keys))


def random_label_distance(annotators: DataFrame, seed: str = "0") -> DataFrame:
    """Mean absolute distance of random labels per item, as a share of the label range."""
    rows = random_labels(annotators, seed)
    keys = [c for c in [*ITEM, "category"] if c in rows.columns]
    n = registry.n_classes(F.col("dataset"))
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(F.col("pred") - F.col("target")) / (n - 1)).alias("avg_abs_dist")
    )


def compared_shares(
    df: DataFrame, keys: list[str], index: Column, n: int, sides: dict[str, Column]
) -> DataFrame:
    """Distributions of several subsets of a group side by side, in one pass.

    ``sides`` maps a column name to the condition of its subset. A subset without
    rows gives null.
    """
    names = {side: f"__{i}" for i, side in enumerate(sides)}
    rows = df.withColumns({"__i": index, **{names[s]: condition for s, condition in sides.items()}})
    counts = [
        F.expr(f"count_if({c} AND __i = {k})").alias(f"{c}_{k}") for c in names.values() for k in range(n)
    ]
    sizes = [F.expr(f"count_if({c})").alias(f"{c}_n") for c in names.values()]
    grouped = rows.groupBy(*keys).agg(*counts, *sizes)

    def vector(c: str) -> Column:
        shares = ", ".join(f"{c}_{k} / {c}_n" for k in range(n))
        return F.expr(f"if({c}_n > 0, array({shares}), NULL)")

    return grouped.select(*keys, *[vector(c).alias(side) for side, c in names.items()])
