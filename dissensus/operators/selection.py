"""Choosing one row, or some rows, of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dissensus.functions import rng
from dissensus.operators import nulls, ordering
from dissensus.schemas import EXAMPLE


def tie_keys(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("run_idx",) if c in df.columns]


def oracle(df: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    """The answer with the lowest metric of each item; ties go to the first run."""
    keys = keys or [c for c in EXAMPLE if c in df.columns]
    return ordering.first_rows(
        df.where(F.col(metric).isNotNull()), keys, [F.col(metric), *tie_keys(df)]
    )


def best_by_score(
    df: DataFrame, keys: list[str] | None = None, score: str = "score", tie: list[Column] | None = None
) -> DataFrame:
    """The answer with the highest score of each item."""
    keys = keys or ["dataset_idx"]
    order = [-F.col(score), *(tie_keys(df) if tie is None else tie)]
    return ordering.first_rows(df.where(F.col(score).isNotNull()), keys, order)


def earliest(df: DataFrame, keys: list[str], time: str = "timestamp", tie: list[Column] = ()) -> DataFrame:
    return ordering.first_rows(df, keys, [F.col(time).asc_nulls_last(), *tie])


def first_per_item(df: DataFrame, keys: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The first run of each item: a row of it, or the ``whole`` of its rows."""
    keys = keys or ["dataset_idx"]
    if not whole:
        return ordering.first_rows(df, keys, tie_keys(df))
    # A rank is trimmed on the map side as row numbers are.
    rank = F.rank().over(W.partitionBy(*keys).orderBy(*tie_keys(df)))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def extremes(df: DataFrame, keys: list[str], score: str, tie: list[Column]) -> DataFrame:
    """Tag the row with the highest score ``best``, the lowest ``worst``, others ``in-between``.

    The two rows are found by aggregates with partial results on the map side and
    come back by a join on the item. A single row is both; it is tagged ``worst``.
    """
    place = F.struct(F.col(score).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    inverse = F.struct((-F.col(score)).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    rows = df.withColumns({"__low": place, "__high": inverse})
    ends = rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.min("__low").alias("__min"), F.min("__high").alias("__max")
    )
    tag = (
        F.when(F.col("__low") == F.col("__min"), "worst")
        .when(F.col("__high") == F.col("__max"), "best")
        .otherwise("in-between")
    )
    return nulls.join(rows, ends, keys, "left").withColumn("rating", tag).drop(
        "__low", "__high", "__min", "__max"
    )


def group_ranks(
    df: DataFrame,
    keys: list[str],
    col: str,
    tie: list[Column],
    name: str | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Rank of a row in its item by a column, ascending, ties in the given order."""
    return ordering.ranked(df, keys, [F.col(col), *tie], name or f"{col}_rank", bound=bound)


def mean_by_rank(ranked: DataFrame, rank: str, cols: list[str]) -> DataFrame:
    return ranked.groupBy(rank).agg(*[F.avg(c).alias(c) for c in cols])


def last_value(df: DataFrame, keys: list[str], col: str, time: str = "timestamp") -> DataFrame:
    """Value of the latest row of each group."""
    return df.groupBy(*keys).agg(F.max_by(col, time).alias(col))


def random_rows(df: DataFrame, keys: list[str], row_key: list[Column], n: int = 1, seed: str = "0") -> DataFrame:
    """``n`` rows of each group in a reproducible random order."""
    order = [rng.order_key(F.lit(seed), *row_key), *row_key]
    return ordering.first_rows(df, keys, order, n)


# Up to this many rows the first ones are found as a top-n, which the driver merges.
TOP_ROWS = 10_000


def first_ids(df: DataFrame, n: int, key: str, order: list[Column]) -> DataFrame:
    """The first ``n`` distinct ids in an order."""
    ids = df.select(key).distinct()
    if n <= TOP_ROWS:
        return ids.orderBy(*order).limit(n)
    return ordering.first_rows(ids, [], order, n)


def random_items(df: DataFrame, n: int, key: str = "dataset_idx", seed: str = "0") -> DataFrame:
    """A reproducible random subset of ``n`` item ids.

    The order is by hash, so the subset for a larger ``n`` contains this one.
    """
    return first_ids(df, n, key, [rng.order_key(F.lit(seed), F.col(key)), F.col(key)])


def random_items_by_dataset(df: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """``n`` random items of each dataset."""
    ids = df.select("dataset", "dataset_idx").distinct()
    return random_rows(ids, ["dataset"], [F.col("dataset_idx")], n, seed)


def only_items(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, ids.columns, "left_semi")


def answers_to_grade(
    df: DataFrame, n_items: int | None, n_runs: int | None, at_random: bool = False
) -> DataFrame:
    """Runs below ``n_runs`` of the first, or of random, ``n_items`` items; all where None."""
    runs = df if n_runs is None else df.where(F.col("run_idx") < n_runs)
    if n_items is None:
        return runs
    if at_random:
        return only_items(runs, random_items(df, n_items))
    return only_items(runs, first_ids(df, n_items, "dataset_idx", [F.col("dataset_idx")]))


def shard(df: DataFrame, keys: list[str], rank: int, world: int) -> DataFrame:
    """One of ``world`` disjoint shares of the rows, by the hash of the key."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(world)) == rank)


def shard_by_position(df: DataFrame, order: list[Column], rank: int, world: int) -> DataFrame:
    """Every ``world``-th row in the given total order, starting at ``rank``."""
    placed = ordering.running_total(df, [], order, name="__pos")
    return placed.where(F.pmod("__pos", F.lit(world)) == rank).drop("__pos")


def head_and_tail(df: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows in a total order, and all others."""
    head = df.orderBy(*order).limit(n)
    marked = head.select(F.max(F.struct(*order)).alias("__last"))
    # One row: the place of the last head row.
    place = F.struct(*order)
    tail = df.where(F.coalesce(place > marked.scalar(), F.lit(True)))
    return head, tail


def half_correct_problems(df: DataFrame, n: int, key: str = "problem_id") -> DataFrame:
    """Solutions of the first ``n`` problems of which exactly half are correct."""
    rates = df.groupBy(key).agg(
        F.count_if("correct").alias("__right"), F.count(F.lit(1)).alias("__all")
    )
    chosen = rates.where(F.col("__right") * 2 == F.col("__all")).orderBy(key).limit(n)
    return df.join(chosen.select(key), key, "left_semi")


def shuffled(df: DataFrame, key: list[Column], seed: str = "0") -> DataFrame:
    """All rows in a reproducible random order."""
    return df.orderBy(rng.order_key(F.lit(seed), *key), *key)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
