"""Result files from cleaned answers, or from per-annotator labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dissensus import registry
from dissensus.operators import cleaning, distributions, joins, ordering, reshape, selection, votes
from dissensus.schemas import ITEM
from dissensus.session import written
from dissensus.sources import submissions


def ready_answers(raw: DataFrame, task: str, order: list[Column] | None = None) -> DataFrame:
    """Valid predictions, of repeated answers to one (item, run) the first.

    The order is by time and then by content unless one is given, so the rows of an
    answer's categories stay together.
    """
    preds = cleaning.clean(raw, task, discard_invalid=True)
    if order is None:
        order = [F.col(c).asc_nulls_last() for c in ("timestamp",) if c in preds.columns]
        order.append(F.xxhash64("response"))
    # An answer has a row for each of its categories, of which there are few.
    keys = ordering.numbers_first(preds, ITEM)
    preds = ordering.together(preds, keys, bound=raw)
    return cleaning.distinct_answers(preds, [*keys, "run_idx", "category"], order)


def soft_label_table(raw: DataFrame, items: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Mean distribution of every item in item order, checked, as text."""
    preds = ready_answers(raw, cleaning.SOFT, order)
    keys = [*ITEM, "category"]
    average = submissions.must_sum_to_one(distributions.mean_vectors(preds, keys, width=registry.MAX_CLASSES))
    return in_order(submissions.as_text(average), items)


def perspectivist_table(
    raw: DataFrame, items: DataFrame, order: list[Column] | None = None
) -> DataFrame:
    """First fitting answer of every item in item order, checked, as text."""
    preds = ready_answers(raw, cleaning.PERSPECTIVIST, order)
    keys = ordering.numbers_first(preds, ITEM)
    kept = [c for c in (*ITEM, "ord") if c in items.columns]
    items = written(items.select(*kept, F.size("annotator_ids").alias("n_annotators")), "items")
    # What follows is by item, and by run within it: no row is dealt to another task.
    counted = cleaning.annotator_count(preds.where(F.col("run_idx").isNotNull()), [*keys, "run_idx"], on_rows=True)
    # A difference, as two equal columns would be one more key of the join.
    fitting = counted.join(items.select(*ITEM, "n_annotators"), keys).where(
        F.col("n_pred_annotators") - F.col("n_annotators") == 0
    )
    chosen = selection.first_per_item(fitting, keys, whole=True).select(*ITEM, "category", "pred")
    return in_order(submissions.as_text(chosen), items, kept=True)


def label_table(preds: DataFrame, items: DataFrame, task: str) -> DataFrame:
    """Per-annotator labels reduced for the task, in item order, checked, as text."""
    if task == cleaning.SOFT:
        reduced = submissions.must_sum_to_one(distributions.soft_labels(preds))
    else:
        voted = votes.vote(preds, "mode", [*ITEM, "annotator_ids"])
        reduced = submissions.must_have_annotators(
            joins.labels_in_annotator_order(voted, items), items
        )
    return in_order(submissions.as_text(reduced), items).where(F.col("pred").isNotNull())


def in_order(preds: DataFrame, items: DataFrame, kept: bool = False) -> DataFrame:
    """Predictions in item order; items that are not ``kept`` are written for it."""
    if "ord" in items.columns:
        return joins.in_item_order(preds, items)
    items = items if kept else written(items.select(*ITEM), "items")
    return joins.in_item_order(preds, reshape.item_order(items, kept=True), n=items.count())


def write_all(tables: dict[tuple[str, str], DataFrame], folder: str) -> list[str]:
    """Write each (dataset, task) table to its file; returns the paths.

    The checks run while the rows are written. All files go to a draft folder first and
    are moved when the last one is whole; a marker is written after that, and
    ``read_one`` asks for it. If a check fails, nothing stays behind. A folder that is
    committed already is an error.
    """
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    if submissions.is_committed(spark, folder):
        raise FileExistsError(f"{folder} holds a submission")
    names = {key: submissions.file_name(*key) for key in tables}
    with submissions.drafts(spark, folder, list(names.values())) as draft:
        for (dataset, task), df in tables.items():
            submissions.write(df.where(F.col("dataset") == dataset), f"{draft}/{names[dataset, task]}")
    return [f"{folder}/{name}" for name in names.values()]


def read_one(spark: SparkSession, folder: str, dataset: str, task: str, kind: str) -> DataFrame:
    """A result file of a committed folder."""
    if not submissions.is_committed(spark, folder):
        raise submissions.InvalidSubmission(f"{folder} is not committed")
    return submissions.read(spark, f"{folder}/{submissions.file_name(dataset, task)}", kind)
