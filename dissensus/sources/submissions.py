"""Checked, ordered result files."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dissensus import registry, schemas
from dissensus.functions import vectors
from dissensus.operators import cleaning, ordering
from dissensus.operators.joins import RowCountError
from dissensus.schemas import ITEM


class InvalidSubmission(ValueError):
    """A table failed the check before its export."""


def require_sum_to_one(df: DataFrame, atol: float = 1e-6) -> DataFrame:
    """Raise unless every vector sums to 1; stops at the first that does not."""
    if not df.where(~vectors.sums_to_one(F.col("pred"), atol)).isEmpty():
        raise InvalidSubmission("a prediction does not sum to 1")
    return df


def must_sum_to_one(df: DataFrame, atol: float = 1e-6) -> DataFrame:
    """As require_sum_to_one, but checked while the rows are written: the job fails."""
    checked = F.when(vectors.sums_to_one(F.col("pred"), atol), F.col("pred")).otherwise(
        F.raise_error(F.lit("a prediction does not sum to 1")).cast("array<double>")
    )
    return df.withColumn("pred", checked)


def must_have_annotators(df: DataFrame, items: DataFrame) -> DataFrame:
    """As require_annotators for lists without categories, checked while they are written."""
    sizes = items.select(*ITEM, F.size("annotator_ids").alias("__n")).distinct()
    checked = F.when(F.size("pred") == F.col("__n"), F.col("pred")).otherwise(
        F.raise_error(F.lit("a prediction has another number of annotators than its item")).cast("array<int>")
    )
    return df.join(sizes, ITEM, "left").withColumn("pred", checked).drop("__n")


def annotator_mismatches(preds: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose prediction has another number of annotators than the item."""
    keys = [c for c in ITEM if c in preds.columns]
    counted = cleaning.annotator_count(preds, keys)
    expected = items.select(*keys, F.size("annotator_ids").alias("n_item_annotators")).distinct()
    return counted.join(expected, keys, "left").where(
        ~F.col("n_pred_annotators").eqNullSafe(F.col("n_item_annotators"))
    )


def require_annotators(preds: DataFrame, items: DataFrame) -> DataFrame:
    if not annotator_mismatches(preds, items).isEmpty():
        raise InvalidSubmission("a prediction has another number of annotators than its item")
    return preds


def row_check(preds: DataFrame, items: DataFrame, runs: int = 10, tolerance: float = 0.01) -> DataFrame:
    """One row: answers expected and found, and whether they differ by more than 1%."""
    found = preds.select("dataset_idx", "run_idx").distinct().agg(F.count(F.lit(1)).alias("found"))
    wanted = items.select("dataset_idx").distinct().agg((F.count(F.lit(1)) * runs).alias("expected"))
    both = wanted.join(found, F.lit(True), "inner")
    return both.withColumn(
        "off", F.abs(F.col("found") - F.col("expected")) > 1e-8 + tolerance * F.col("expected")
    )


def as_text(df: DataFrame) -> DataFrame:
    """The prediction of an item as JSON text; categories in the order of the file format."""
    keys = [c for c in [*ITEM, "ord"] if c in df.columns]
    if "category" not in df.columns:
        return df.select(*keys, F.to_json("pred").alias("pred"))
    order = registry.lookup(
        F.col("category"), {c: i for i, c in enumerate(registry.SUBMISSION_CATEGORIES)}, F.lit(0)
    )
    # A window, as a hash table of lists turns into a sort of its own soon.
    group = W.partitionBy(*ordering.numbers_first(df, keys))
    entry = F.struct(order.alias("o"), "category", "pred")
    lists = df.select(
        *keys,
        F.array_sort(F.collect_list(entry).over(group)).alias("__l"),
        F.row_number().over(group.orderBy(F.lit(0))).alias("__rn"),
    ).where(F.col("__rn") == 1)
    single = (F.size("__l") == 1) & (F.col("__l")[0]["category"] == "")
    text = F.when(single, F.to_json(F.col("__l")[0]["pred"])).otherwise(
        F.to_json(F.transform("__l", lambda x: x["pred"]))
    )
    return lists.select(*keys, text.alias("pred"))


def write(df: DataFrame, path: str) -> None:
    """Rows of (dataset_idx, pred) in item order, tab separated, without header.

    The part files are sorted ranges: read in the order of their names they are the
    ordered file. No task writes more than its range.
    """
    out = df.orderBy("ord") if "ord" in df.columns else df
    out.select("dataset_idx", "pred").write.options(
        sep="\t", header=False, quote="", escapeQuotes=False
    ).csv(path)


COMMITTED = "_COMMITTED"


def file_system(spark: SparkSession, folder: str):
    """Hadoop's path class, and the file system of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def is_committed(spark: SparkSession, folder: str) -> bool:
    path, fs = file_system(spark, folder)
    return fs.exists(path(f"{folder}/{COMMITTED}"))


@contextlib.contextmanager
def drafts(spark: SparkSession, folder: str, names: list[str]) -> Iterator[str]:
    """A draft folder whose named files are moved up to the folder at the end.

    The marker comes last. A file that a run without marker left under a name is
    replaced; an error leaves no draft.
    """
    path, fs = file_system(spark, folder)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    try:
        yield draft
        for name in names:
            target = path(f"{folder}/{name}")
            if fs.exists(target):
                fs.delete(target, True)
            if not fs.rename(path(f"{draft}/{name}"), target):
                raise InvalidSubmission(f"{name} could not be moved")
        fs.create(path(f"{folder}/{COMMITTED}")).close()
    finally:
        fs.delete(path(draft), True)


def read(spark: SparkSession, path: str, kind: str = "array<double>") -> DataFrame:
    """A result file, with the prediction parsed as the given type."""
    lines = spark.read.schema(schemas.SUBMISSION).options(sep="\t", quote="").csv(path)
    return lines.select("dataset_idx", F.from_json("pred", kind).alias("pred"))


def file_name(dataset: str, task: str) -> str:
    suffix = {cleaning.SOFT: "soft", cleaning.PERSPECTIVIST: "pe"}[task]
    return f"{registry.SCHEMES[dataset].file_name}_test_{suffix}.tsv"


def require_rows(df: DataFrame, expected: DataFrame) -> DataFrame:
    n, m = df.count(), expected.count()
    if n != m:
        raise RowCountError(f"expected {m} rows, got {n}")
    return df


def category_order(pred: Column) -> Column:
    """Values of a map from category, in the order of the file format."""
    return F.array(*[pred[c] for c in registry.SUBMISSION_CATEGORIES])
