"""Joins of items, answers, annotators and grades.

Answers are the large side and come left, so that a join on a much repeated item
can be split by adaptive skew handling; dimensions are left to Spark's size
check before it broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus.functions import text
from dissensus.operators import ordering
from dissensus.schemas import ITEM

# Fixed value: what an annotator without metadata gets.
UNKNOWN_ANNOTATOR = {"data": "there is no information about the annotator"}


class RowCountError(ValueError):
    """A join or an export did not keep the rows it has to keep."""


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    names = ["dataset", "n_classes", "split", "dataset_idx", "category"]
    return [c for c in names if c in left.columns and c in right.columns]


def join_items(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answers with their item, over the key columns both sides have."""
    keys = shared_keys(answers, items)
    joined = answers.join(items, item_keys(answers, items), "inner")
    return joined.select(*keys, *[c for c in joined.columns if c not in keys])


def item_keys(answers: DataFrame, items: DataFrame) -> list[str]:
    """The keys of ``join_items``, in the order that the merge sorts by.

    Without the number of classes, items that were aggregated lie in the tasks of the
    join already if the keys are in their usual order.
    """
    keys = shared_keys(answers, items)
    return ordering.numbers_first(answers, keys) if "n_classes" in keys else keys


def items_in_use(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items of the (dataset, split) pairs that occur among the answers."""
    return items.join(answers.select("dataset", "split").distinct(), ["dataset", "split"], "left_semi")


def annotator_rows(items: DataFrame, id_col: str = "annotator_ids") -> DataFrame:
    """One row per annotator of an item, with its position ``pos``."""
    return items.select("*", F.posexplode(id_col).alias("pos", "annotator_id"))


def with_metadata(rows: DataFrame, annotators: DataFrame) -> DataFrame:
    """Metadata of each annotator row; an id ``Ann7`` also finds ``7``."""
    known = annotators.select("dataset", "annotator_id", F.col("attrs").alias("__exact"))
    plain = annotators.select(
        "dataset", F.col("annotator_id").alias("__plain"), F.col("attrs").alias("__fallback")
    )
    default = F.create_map(*[F.lit(x) for kv in UNKNOWN_ANNOTATOR.items() for x in kv])
    return (
        rows.withColumn("__plain", F.replace("annotator_id", F.lit("Ann"), F.lit("")))
        .join(known, ["dataset", "annotator_id"], "left")
        .join(plain, ["dataset", "__plain"], "left")
        .withColumn("metadata", F.coalesce("__exact", "__fallback", default))
        .drop("__plain", "__exact", "__fallback")
    )


def collect_metadata(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metadata of an item as one list in annotator order.

    The list is as long as the annotator list the item row already holds.
    """
    # Maps have no order, so their entries are sorted along with the position.
    pairs = F.struct("pos", F.map_entries("metadata").alias("entries"))
    return rows.groupBy(*(keys or ITEM)).agg(
        F.transform(
            F.array_sort(F.collect_list(pairs)), lambda x: F.map_from_entries(x["entries"])
        ).alias("annotator_metadata")
    )


def missing_answers(wanted: DataFrame, done: DataFrame, spec: dict | None = None) -> DataFrame:
    """Wanted (item, run) rows without a successful earlier answer."""
    from dissensus.operators.cleaning import equal_to

    keys = [*ITEM, "run_idx"]
    finished = equal_to(done, {**(spec or {}), "success": True}).select(*keys).distinct()
    return wanted.join(finished, keys, "left_anti")


def fewshot_with_solutions(examples: DataFrame, solutions: DataFrame) -> DataFrame:
    """Few-shot examples with the judge's answer; every example needs exactly one."""
    judged = solutions.select(*ITEM, F.col("response").alias("response_judge"))
    joined = examples.withColumnRenamed("response", "response_llm").join(judged, ITEM, "inner")
    n, expected = joined.count(), examples.count()
    if n != expected:
        raise RowCountError(f"{expected} examples but {n} solutions")
    return joined


def in_item_order(
    preds: DataFrame, items: DataFrame, order_col: str = "ord", n: int | None = None
) -> DataFrame:
    """Predictions for every item, in the order of the items; null where one lacks.

    ``n`` says that the order is 0..n-1: then no sample of the joined rows is taken for it.
    """
    keys = [c for c in ITEM if c in preds.columns]
    joined = items.select(*keys, order_col).join(preds, ordering.numbers_first(items, keys), "left")
    joined = joined.select(*keys, order_col, *[c for c in preds.columns if c not in keys])
    return joined.orderBy(order_col) if n is None else ordering.in_places(joined, order_col, n)


def labels_in_annotator_order(preds: DataFrame, items: DataFrame) -> DataFrame:
    """Labels of an item's annotators as one list, ordered like ``annotator_ids``.

    The list is at most as long as the annotator list the item row already holds.
    """
    order = annotator_rows(items.select(*ITEM, "annotator_ids")).drop("annotator_ids")
    labels = preds.select(*ITEM, F.col("annotator_ids").alias("annotator_id"), "pred")
    rows = order.join(labels, [*ITEM, "annotator_id"], "inner").where(F.col("pred").isNotNull())
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col("pred").cast("int").alias("pred"))))
    return rows.groupBy(*ITEM).agg(F.transform(pairs, lambda x: x["pred"]).alias("pred"))


def join_grades(answers: DataFrame, grades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Answers with a judge's score; answers without one are left out."""
    keys = keys or ["dataset_idx", "run_idx"]
    scored = grades.where(F.col("score").isNotNull())
    return answers.join(scored, keys, "inner")


def join_correctness(answers: DataFrame, correct: DataFrame, levels: DataFrame, level: str = "mixed") -> DataFrame:
    """Answers with their correctness, of the items at one level of correctness."""
    keys = [c for c in ("dataset", "dataset_idx", "run_idx") if c in correct.columns]
    chosen = levels.where(F.col("correct_level") == level).select("dataset_idx")
    return answers.join(correct, keys, "inner").join(chosen, "dataset_idx", "left_semi")


def compare_raters(
    human: DataFrame, model: DataFrame, key: str = "dataset_idx", col: str = "ratings"
) -> DataFrame:
    """Step ratings of two raters side by side, where both rated as many steps."""
    left = human.withColumnRenamed(col, f"{col}_human")
    right = model.select(key, F.col(col).alias(f"{col}_model"))
    return left.join(right, key, "inner").where(F.size(f"{col}_human") == F.size(f"{col}_model"))


def problem_ids(df: DataFrame, col: str = "problem") -> DataFrame:
    """Id of a problem from its text: the same on every run, without a global sort."""
    return df.withColumn("problem_id", F.md5(col))


def numbered_problems(df: DataFrame, col: str = "problem") -> DataFrame:
    """Dense problem numbers 0, 1, .. in text order, over the distinct problems only."""
    from dissensus.operators.ordering import running_total

    distinct = df.select(col).distinct()
    numbers = running_total(distinct, [], [F.col(col)], name="problem_id")
    return df.join(numbers, col, "inner")


def with_parsed_steps(df: DataFrame) -> DataFrame:
    return df.withColumn("n_steps", F.size(text.answer_steps(F.col("response"))))
