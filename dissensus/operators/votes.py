"""Voting: one label from many, per annotator, position or item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.functions import text
from dissensus.schemas import ITEM

# Vote rules as aggregates over the integer column ``pred``. Their state is one
# counter per distinct label. Of equally frequent labels the lowest wins.
RULES: dict[str, Column | str] = {
    "mode": "mode(pred, true)",
    "median_low": "percentile_disc(0.5) within group (order by pred)",
    "median_high": "percentile_disc(0.5) within group (order by pred desc)",
}


def vote_keys(df: DataFrame) -> list[str]:
    return [c for c in [*ITEM, "annotator_ids", "target"] if c in df.columns]


def vote(df: DataFrame, rule: str = "mode", keys: list[str] | None = None) -> DataFrame:
    """One label per annotator of an item."""
    return df.groupBy(*(keys or vote_keys(df))).agg(F.expr(RULES[rule]).cast("int").alias("pred"))


def all_votes(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All vote rules in one pass, as rows of (keys, name, pred)."""
    keys = keys or vote_keys(df)
    wide = df.groupBy(*keys).agg(
        *[F.expr(sql).cast("int").alias(f"maj({rule})") for rule, sql in RULES.items()]
    )
    return wide.unpivot(keys, [f"maj({r})" for r in RULES], "name", "pred")


def position_votes(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Most frequent label at each position of the label lists of a group.

    Labels are counted per (group, position) first; of equally frequent labels the
    lowest wins, or the first by ``order``.
    """
    rows = df.select(
        *keys,
        F.posexplode("pred").alias("pos", "label"),
        *([F.struct(*order).alias("__o")] if order else []),
    )
    counts = rows.groupBy(*keys, "pos", "label").agg(
        F.count(F.lit(1)).alias("n"), *([F.min("__o").alias("__o")] if order else [])
    )
    tie = F.col("__o") if order else F.col("label")
    best = F.min_by("label", F.struct((-F.col("n")).alias("n"), tie.alias("tie")))
    return counts.groupBy(*keys, "pos").agg(best.alias("pred"))


def position_lists(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Votes of (keys, pos, pred) as one list per group.

    The list is as long as the longest list of labels that was voted on.
    """
    pairs = F.array_sort(F.collect_list(F.struct("pos", "pred")))
    return votes.groupBy(*keys).agg(F.transform(pairs, lambda x: x["pred"]).alias("pred"))


def annotation_rows(items: DataFrame) -> DataFrame:
    """Annotations of the items as rows of (item, pos, annotator_id, label)."""
    entries = F.posexplode(F.map_entries("annotations")).alias("pos", "__e")
    return items.select("*", entries).select(
        *items.columns,
        "pos",
        F.col("__e.key").alias("annotator_id"),
        F.col("__e.value").alias("label"),
    )


def most_frequent_label(rows: DataFrame) -> DataFrame:
    """Each annotator's most frequent label in a dataset; ties go to the lowest."""
    counts = rows.groupBy("dataset", "annotator_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l")))
    return counts.groupBy("dataset", "annotator_id").agg(best.alias("most_frequent"))


def most_frequent_baseline(rows: DataFrame) -> DataFrame:
    """Annotation rows with the annotator's most frequent label and its distance."""
    joined = rows.join(most_frequent_label(rows), ["dataset", "annotator_id"], "inner")
    as_int = lambda c: text.int_or_text(F.col(c)).try_cast("int")
    span = registry.n_classes(F.col("dataset")) - 1
    return joined.withColumn(
        "abs_dist", F.abs(as_int("most_frequent") - as_int("label")) / span
    )


def category_labels(rows: DataFrame, col: str = "label") -> DataFrame:
    """Text labels as 0/1 per category: 1 where the text contains the category."""
    categories = registry.SCHEMES["VariErrNLI"].categories
    marks = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.contains(F.col(col), F.lit(c)).cast("int").alias("pred"))
            for c in categories
        ]
    )
    return rows.select("*", F.inline(marks))


def by_item(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy(*ITEM).agg(F.avg("abs_dist").alias("avg_abs_dist"))
