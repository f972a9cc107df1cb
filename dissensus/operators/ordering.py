"""Rank, running totals, first rows and exact quantiles of groups of any size.

A window function sorts a whole group in one task. One group may hold a third of
all rows, or be the whole table, so these operators first look at the group
sizes. Groups above a limit are cut into value ranges; each range is a window of
its own, and the totals of the ranges before it are added on. A plain window
remains where no group is above the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dissensus.operators import nulls


@dataclass(frozen=True)
class SizeLimit:
    """A group is large above ``rows`` rows and above ``share`` of all rows.

    A large group is cut into ranges of about that size. So there are fewer than
    ``1 / share`` large groups and, all of them together, at most ``2 / share``
    ranges, however large the table is. This bounds the tables that are broadcast.
    """

    rows: int = 1_000_000
    share: float = 1e-4


# Order keys looked at per range when its bounds are chosen.
PICKS = 16

DEFAULT_LIMIT = SizeLimit()


def group_stats(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """Group sizes, and from them the number of rows and the largest size."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    stats = sizes.agg(F.sum("__rows").alias("n"), F.max("__rows").alias("largest")).first()
    return sizes, stats["n"] or 0, stats["largest"] or 0


# Buckets that keys are counted in; a task gives out no more counts than that.
BUCKETS = 65536


def bucket_stats(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """The number of rows, and that of the fullest bucket of keys, which no group is above."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__bucket")
    return group_stats(df.select(bucket), ["__bucket"])[1:]


def most_rows(df: DataFrame, keys: list[str], enough: int) -> tuple[int, int]:
    """The number of rows, and a bound of the largest group's; exact where it is above ``enough``."""
    n, most = bucket_stats(df, keys) if keys else (0, enough + 1)
    return (n, most) if most <= enough else group_stats(df, keys)[1:]


def large_groups(
    df: DataFrame, keys: list[str], limit: SizeLimit = DEFAULT_LIMIT, bound: DataFrame | None = None
) -> tuple[DataFrame, int] | None:
    """Keys of the large groups and the size of a range, or None where there are none.

    Costs one aggregation over the key columns; two numbers come to the driver.
    ``bound`` is a frame that is cheaper to count and has at least as many rows in
    every group, e.g. the rows ``df`` was aggregated from: if it has no large group
    by the keys it shares, ``df`` has none and is not computed for the check.
    """
    if bound is not None:
        shared = [k for k in keys if k in bound.columns]
        if most_rows(bound, shared, limit.rows)[1] <= limit.rows:
            return None
    sizes, n, largest = group_stats(df, keys)
    size = int(max(limit.rows, limit.share * n))
    return None if largest <= size else (sizes.where(F.col("__rows") > size), size)


def rows_if_small(bound: DataFrame | None, keys: list[str], limit: SizeLimit = DEFAULT_LIMIT) -> int | None:
    """The number of rows, if no group is large, so that one task can hold any of them;
    else None. ``bound`` is explained at ``large_groups``; without it nothing is counted."""
    if bound is None:
        return None
    n, most = most_rows(bound, [k for k in keys if k in bound.columns], limit.rows)
    return n if most <= max(limit.rows, limit.share * n) else None


# Rows that a task sorts or groups in memory when groups are dealt to tasks.
TASK_ROWS = 1_000_000


def n_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows; as many as other exchanges have, or a join would deal them anew."""
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-rows // TASK_ROWS))


def together(
    df: DataFrame,
    keys: list[str],
    copies: int = 1,
    limit: SizeLimit = DEFAULT_LIMIT,
    bound: DataFrame | None = None,
) -> DataFrame:
    """The rows dealt to tasks by ``keys``, so that all that follows by these and further
    keys needs no other exchange; as they are where a group is large.

    The number of tasks follows from that of the rows, each of which turns into
    ``copies`` later on. ``bound`` is explained at ``large_groups``.
    """
    n = rows_if_small(df.select(*keys) if bound is None else bound.select(*keys), keys, limit)
    return df if n is None else df.repartition(n_tasks(df.sparkSession, n * copies), *keys)


def numbers_first(df: DataFrame, keys: list[str]) -> list[str]:
    """The keys with numbers, long ones first, before texts: a sort looks at the first bytes
    of the first key, and where they are equal at the rows, as often for a text of few values."""
    kinds = dict(df.dtypes)
    return sorted(keys, key=lambda k: {"bigint": 0, "string": 2}.get(kinds[k], 1))


def in_places(df: DataFrame, place: str, n: int) -> DataFrame:
    """The rows sorted by their place among 0..n-1, in ranges known without a sample."""
    parts = min(n_tasks(df.sparkSession, n), 1 + n // PLACES)
    return df.repartitionById(parts, F.expr(f"CAST({place} * {parts} DIV {n + 1} AS INT)")).sortWithinPartitions(place)


# Places that make up a range at least.
PLACES = 10_000


def range_bounds(df: DataFrame, keys: list[str], order: Column, large: DataFrame, size: int) -> DataFrame:
    """Bounds of the ranges of each large group, as sorted lists of order keys.

    The keys are picked by their hash, each distinct key once, and every 16th of them
    is a bound. The bounds only balance the work: any give the same result, and the
    same rows give the same bounds on every attempt. ``__coarse`` holds every
    ``__step``-th bound, so that a row is placed in two short searches.
    """
    picked = (
        nulls.join(df, F.broadcast(large.select(*keys)), keys)
        .select(*keys, order.alias("__o"))
        .where(F.pmod(F.xxhash64("__o"), F.lit(max(1, size // PICKS))) == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("__o")).alias("__picked"))
    )
    bounds = picked.select(
        *keys, F.filter("__picked", lambda _, i: i % PICKS == PICKS - 1).alias("__bounds")
    )
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__bounds")))).cast("int")
    stepped = bounds.withColumn("__step", step)
    coarse = F.filter("__bounds", lambda _, i: (i + 1) % F.col("__step") == 0)
    return stepped.withColumn("__coarse", coarse)


def with_ranges(
    df: DataFrame, keys: list[str], order: Column, limit: SizeLimit, bound: DataFrame | None = None
) -> DataFrame | None:
    """Number the value range of every row of a large group in ``__range``.

    None where there is no large group. Rows of other groups are in range 0.
    """
    found = large_groups(df, keys, limit, bound)
    if found is None:
        return None
    bounds = range_bounds(df, keys, order, *found)
    placed = nulls.join(df.withColumn("__o", order), F.broadcast(bounds), keys, "left")
    passed = F.size(F.filter("__coarse", lambda b: b <= F.col("__o"))) * F.col("__step")
    placed = placed.withColumn("__passed", passed)
    rest = F.slice("__bounds", F.col("__passed") + 1, F.col("__step"))
    within = F.col("__passed") + F.size(F.filter(rest, lambda b: b <= F.col("__o")))
    return (
        placed.withColumn("__range", F.when(F.col("__bounds").isNull(), 0).otherwise(within))
        .withColumn("__large", F.col("__bounds").isNotNull())
        .drop("__bounds", "__coarse", "__step", "__passed", "__o")
    )


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    weight: Column | None = None,
    name: str = "before",
    total: str | None = None,
    limit: SizeLimit = DEFAULT_LIMIT,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add the total weight of the rows that come before a row in its group.

    ``order`` is ascending and must tell the rows of a group apart. Without a
    weight the result is the number of rows before. ``total`` names a second
    column for the weight of the whole group. ``bound`` is explained at
    ``large_groups``.
    """
    keep = df.columns + [name] + ([total] if total else [])
    if not keys:
        df, keys = df.withColumn("__all_rows", F.lit(0)), ["__all_rows"]
    df = df.withColumn("__w", F.lit(1).cast("bigint") if weight is None else weight)
    ranged = with_ranges(df, keys, F.struct(*order), limit, bound)

    def with_window(data: DataFrame, window_keys: list[str]) -> DataFrame:
        group = W.partitionBy(*window_keys)
        window = group.orderBy(*order)
        if weight is None:
            before = (F.row_number().over(window) - 1).cast("bigint")
        else:
            before = F.sum("__w").over(window.rowsBetween(W.unboundedPreceding, -1))
        data = data.withColumn(name, F.coalesce(before, F.lit(0)))
        return data.withColumn(total, F.sum("__w").over(group)) if total else data

    if ranged is None:
        return with_window(df, keys).select(*keep)
    sums = ranged.where("__large").groupBy(*keys, "__range").agg(F.sum("__w").alias("__w"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "__range",
        F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__w").over(group).alias("__group"),
    )
    joined = nulls.join(with_window(ranged, [*keys, "__range"]), F.broadcast(offsets), [*keys, "__range"], "left")
    joined = joined.withColumn(name, F.col(name) + F.coalesce("__offset", F.lit(0)))
    if total:
        joined = joined.withColumn(total, F.coalesce("__group", total))
    return joined.select(*keep)


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "rank",
    limit: SizeLimit = DEFAULT_LIMIT,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add the position 1, 2, .. of a row in its group."""
    return running_total(df, keys, order, None, name, limit=limit, bound=bound).withColumn(name, F.col(name) + 1)


# Spark trims a group to its first rows before the shuffle up to this many.
GROUP_LIMIT_ROWS = 1000


def first_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int = 1,
    limit: SizeLimit = DEFAULT_LIMIT,
    mark: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group.

    For small ``n`` every map task keeps only its own first rows of a group, so a
    large group does not reach one task whole. ``mark`` keeps all rows and names a
    column that tells the first ones; then groups must be small, as in ``together``.
    """
    if mark is not None:
        place = F.row_number().over(W.partitionBy(*numbers_first(df, keys)).orderBy(*order))
        return df.withColumn(mark, place <= n)
    if n >= GROUP_LIMIT_ROWS or not keys:
        out = ranked(df, keys, order, "__rn", limit)
    else:
        out = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col("__rn") <= n).drop("__rn")


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    limit: SizeLimit = DEFAULT_LIMIT,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (keys, prob, quantile).

    Equal values are counted first, so only distinct values are sorted.
    """
    data = df.where(F.col(value).isNotNull())
    group = keys
    if not keys:
        data, group = data.withColumn("__all_rows", F.lit(0)), ["__all_rows"]
    counts = data.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    places = running_total(
        counts, group, [F.col(value)], F.col("__n"), "__before", "__total", limit, data
    )

    def covers(place: Column) -> Column:
        return (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))

    spots = F.transform(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: F.struct(p.alias("prob"), (p * (F.col("__total") - 1)).alias("pos")),
    )
    touched = places.withColumn(
        "__spot",
        F.explode(
            F.filter(spots, lambda s: covers(F.floor(s["pos"])) | covers(F.ceil(s["pos"])))
        ),
    )
    part = F.col("__spot.pos") - F.floor("__spot.pos")
    return touched.groupBy(*group, F.col("__spot.prob").alias("prob")).agg(
        (F.min(value) + (F.max(value) - F.min(value)) * F.max(part)).alias("quantile")
    ).select(*keys, "prob", "quantile")
