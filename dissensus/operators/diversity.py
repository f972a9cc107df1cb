"""How far the repeated answers to an item lie apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import vectors
from dissensus.operators import nulls, ordering
from dissensus.operators.ordering import DEFAULT_LIMIT, SizeLimit
from dissensus.schemas import ITEM
from dissensus.session import written

QUINTILES = [0.2, 0.4, 0.6, 0.8]


def pairwise_wasserstein(
    df: DataFrame, keys: list[str] | None = None, limit: SizeLimit = DEFAULT_LIMIT
) -> DataFrame:
    """Mean Wasserstein distance over all pairs of vectors of a group; 0 for one vector.

    The distance is a sum over classes of differences of cumulative shares, and the
    sum of |a - b| over all pairs follows from the sorted values: a value with
    ``c`` copies, ``b`` values before it and ``n`` in all counts
    ``c * (2b + c - n)`` times. No pair is formed, and equal values are counted
    before they are sorted. Where no group is large its vectors meet in one task before
    they are taken apart, so that neither points nor counts are shuffled. Where all are
    small, a group's vectors are a list and its points are sorted in place.
    """
    keys = keys or ITEM
    df = df.select(*keys, "pred")
    n, most = ordering.most_rows(df.select(*keys), keys, LIST_ROWS)
    if most <= min(LIST_ROWS, limit.rows):
        return listed_wasserstein(df.repartition(ordering.n_tasks(df.sparkSession, n), *keys), keys)
    df = ordering.together(df, keys, registry.MAX_CLASSES, limit)
    points = df.select(*keys, F.posexplode(vectors.cumulative(F.col("pred"))).alias("class", "v"))
    counts = points.groupBy(*keys, "class", "v").agg(F.count(F.lit(1)).alias("c"))
    placed = ordering.running_total(
        counts, [*keys, "class"], [F.col("v")], F.col("c"), "b", "n", limit, df.select(*keys)
    )
    copies = F.col("c") * (2 * F.col("b") + F.col("c") - F.col("n"))
    return placed.groupBy(*keys).agg(
        F.coalesce(
            F.try_divide(
                F.sum(F.col("v") * copies), F.max(F.col("n") * (F.col("n") - 1) / 2)
            ),
            F.lit(0.0),
        ).alias("avg_pairwise_ws_loss")
    )


# Vectors of a group that are held as a list.
LIST_ROWS = 10_000


def listed_wasserstein(df: DataFrame, keys: list[str]) -> DataFrame:
    """As ``pairwise_wasserstein``, from a list of each group's vectors.

    Of ``n`` sorted values the one with ``b`` before it counts ``2b + 1 - n`` times.
    """
    # Without a filter on rows, which would compute each vector once more below the shuffle.
    vector = F.when(F.size("pred") > 0, F.col("pred"))
    lists = df.groupBy(*keys).agg(F.collect_list(vector).alias("__all")).where(F.size("__all") > 0)
    # Sorted nulls first, as a window does; they count in n alone.
    value = """
        transform(sequence(0, array_max(transform(__vs, v -> size(v))) - 1), k ->
          transform(array(array_sort(
              transform(filter(__vs, v -> size(v) > k), v -> v[k]),
              (x, y) -> CASE WHEN x IS NULL AND y IS NULL THEN 0 WHEN x IS NULL THEN -1 WHEN y IS NULL THEN 1
                             WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END)),
            s -> struct(
              aggregate(transform(s, (x, b) -> x * (2 * b + 1 - size(s))), CAST(NULL AS DOUBLE),
                        (a, x) -> if(x IS NULL, a, coalesce(a, 0D) + x)) AS d,
              CAST(size(s) AS DOUBLE) * (size(s) - 1) / 2 AS pairs))[0])"""
    sums = "aggregate(__per_class, CAST(NULL AS DOUBLE), (a, t) -> if(t.d IS NULL, a, coalesce(a, 0D) + t.d))"
    mean = f"coalesce(try_divide({sums}, array_max(transform(__per_class, t -> t.pairs))), 0D)"
    several = lists.withColumn("__vs", F.when(F.size("__all") > 1, F.transform("__all", vectors.cumulative)))
    per_class = several.withColumn("__per_class", F.when(F.col("__vs").isNotNull(), F.expr(value)))
    # One vector has no pair.
    distance = F.when(F.col("__vs").isNull(), F.lit(0.0)).otherwise(F.expr(mean))
    return per_class.select(*keys, distance.alias("avg_pairwise_ws_loss"))


def quintile(value: Column, edges: list[Column]) -> Column:
    """Q1..Q5 by the four inner edges; each bin includes its upper edge. Null without edges."""
    tag = F.when(value <= edges[0], "Q1")
    for i, edge in enumerate(edges[1:], start=2):
        tag = tag.when(value <= edge, f"Q{i}")
    return F.when(value.isNotNull() & edges[-1].isNotNull(), tag.otherwise("Q5"))


def with_quintile(
    df: DataFrame,
    value: str = "avg_pairwise_ws_loss",
    by: list[str] | None = None,
    limit: SizeLimit = DEFAULT_LIMIT,
) -> DataFrame:
    """Add the quintile of a value, over all rows or within the groups ``by``."""
    by = by or []
    edges = (
        ordering.quantiles(df, by, value, QUINTILES, limit)
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"__q{i}") for i, p in enumerate(QUINTILES)])
    )
    names = [f"__q{i}" for i in range(len(QUINTILES))]
    tag = quintile(F.col(value), [F.col(n) for n in names])
    if by:
        joined = nulls.join(df, edges, by, "left")
    else:
        one_row = edges.select(F.struct(*names).alias("__q"))
        joined = df.withColumn("__q", one_row.scalar()).select("*", "__q.*").drop("__q")
    return joined.withColumn("diversity", tag).drop(*names)


def by_problem(df: DataFrame, keys: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Diversity and its quintile for each item; with categories, their mean."""
    keys = keys or ITEM
    if "category" in df.columns:
        parts = pairwise_wasserstein(df, [*keys, "category"])
        value = parts.groupBy(*keys).agg(
            F.avg("avg_pairwise_ws_loss").alias("avg_pairwise_ws_loss")
        )
    else:
        value = pairwise_wasserstein(df, keys)
    # One row per item, read by the quantiles and by the tagging.
    return with_quintile(written(value, "diversity"), by=by)


def most_diverse(df: DataFrame, diversity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Answers to the items of the top quintile."""
    keys = keys or ITEM
    chosen = diversity.where(F.col("diversity") == "Q5").select(*keys)
    return df.join(chosen, keys, "left_semi")


def with_diversity(df: DataFrame, diversity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.join(diversity, keys or ITEM, "inner")


def improvements(
    answers: DataFrame, average: DataFrame, best: DataFrame, diversity: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Gain of the averaged and of the best answer over each single answer.

    The three item tables have one row per item and are joined first, so the
    answers take part in one join only.
    """
    keys = keys or ITEM
    # Merges sort by the keys in this order.
    by = ordering.numbers_first(answers, keys)
    per_item = (
        diversity.select(*keys, "diversity")
        .join(average.select(*keys, F.col("ws_loss").alias("__avg")), by, "left")
        .join(best.select(*keys, F.col("ws_loss").alias("__best")), by, "left")
    )
    joined = answers.join(per_item, by, "left")
    return (
        joined.select(*keys, *[c for c in joined.columns if c not in keys])
        .withColumns(
            {
                "model_avg_improvement": F.col("ws_loss") - F.col("__avg"),
                "oracle_improvement": F.col("ws_loss") - F.col("__best"),
            }
        )
        .drop("__avg", "__best")
    )


def captured_fraction(gains: DataFrame, by: list[str]) -> DataFrame:
    """Mean gains by group, and the share of the possible gain that averaging gets."""
    means = gains.groupBy(*by).agg(
        F.avg("model_avg_improvement").alias("model_avg_improvement"),
        F.avg("oracle_improvement").alias("oracle_improvement"),
    )
    return means.withColumn(
        "fraction", F.try_divide("model_avg_improvement", "oracle_improvement")
    )
