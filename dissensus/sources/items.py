"""Items with their labels, and annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissensus import registry, schemas
from dissensus.operators import cleaning, joins, metrics
from dissensus.sources import keyed_json


def read_keyed_json(spark: SparkSession, path: str | list[str], schema: str = schemas.RAW_ITEM) -> DataFrame:
    """Files that are one JSON object from item id to item, as one row per item.

    A large file is read by several tasks (``keyed_json``).
    """
    rows = keyed_json.entries(spark, path, f"struct<{as_fields(schema)}>")
    return rows.select(F.col("key").cast("bigint").alias("dataset_idx"), "value.*")


def as_fields(schema: str) -> str:
    """A column list as the fields of a struct type."""
    return ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def convert_keyed_json(spark: SparkSession, path: str, target: str, dataset: str, split: str) -> None:
    df = read_keyed_json(spark, path)
    df = df.withColumns({"dataset": F.lit(dataset), "split": F.lit(split)})
    df.write.mode("append").partitionBy("dataset", "split").parquet(target)


def read_items(spark: SparkSession, path: str, datasets: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """Items from Parquet partitioned by dataset and split; only the named partitions."""
    df = spark.read.parquet(path)
    if datasets:
        df = df.where(F.col("dataset").isin(datasets))
    if splits:
        df = df.where(F.col("split").isin(splits))
    return df


def with_targets(items: DataFrame, task: str = cleaning.SOFT) -> DataFrame:
    """Targets in rows of (item, category, target).

    For soft labels the target is a vector, with its holes and entropy. For
    per-annotator labels it is a list in the order of ``annotator_ids``.
    """
    df = cleaning.with_classes(items)
    if task == cleaning.SOFT:
        return metrics.with_target_columns(soft_targets(df))
    return label_targets(df)


def soft_targets(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)["soft_label"]
    if kind == "map<string,double>":
        vector = cleaning.strict_vector(F.col("soft_label"), F.col("dataset"))
        return df.withColumns({"category": F.lit(""), "target": vector})
    entries = F.transform(
        F.map_entries("soft_label"),
        lambda e: F.struct(
            e["key"].alias("category"),
            cleaning.strict_vector(e["value"], F.col("dataset")).alias("target"),
        ),
    )
    return df.drop("category", "target").select("*", F.inline(entries))


def annotator_ids(annotations: Column) -> Column:
    return F.map_keys(annotations)


def label_targets(df: DataFrame) -> DataFrame:
    labels = F.map_values("annotations")
    single = F.array(
        F.struct(
            F.lit("").alias("category"),
            F.transform(labels, lambda v: v.try_cast("double").cast("int")).alias("target"),
        )
    )

    def holds(category: str) -> Column:
        return F.transform(labels, lambda v: F.contains(v, F.lit(category)).cast("int"))

    by_category = F.array(
        *[
            F.struct(F.lit(c).alias("category"), holds(c).alias("target"))
            for c in registry.SCHEMES["VariErrNLI"].categories
        ]
    )
    rows = F.when(registry.n_categories(F.col("dataset")) == 1, single).otherwise(by_category)
    ids = annotator_ids(F.col("annotations"))
    return df.withColumns(
        {"annotator_ids": ids, "n_annotators": F.size(F.array_distinct(ids))}
    ).drop("category", "target").select("*", F.inline(rows))


ITEM_COLUMNS = [
    "dataset", "soft_label", "annotations", "annotator_metadata", "annotator_ids",
    "n_annotations", "n_annotators", "n_classes", "split", "dataset_idx", "category",
    "target", "text", "tgt_has_holes", "target_entropy",
]


def load_items(
    items: DataFrame, annotators: DataFrame | None = None, task: str | None = cleaning.SOFT
) -> DataFrame:
    """Items with targets, annotator ids and metadata, and only the known columns.

    Without a task no target is parsed.
    """
    df = items.withColumnRenamed("number of annotations", "n_annotations")
    if "n_annotators" not in df.columns:
        df = df.withColumnRenamed("number of annotators", "n_annotators")
    df = df.withColumn("annotator_ids", annotator_ids(F.col("annotations")))
    if annotators is not None:
        rows = joins.annotator_rows(df.select(*schemas.ITEM, "annotator_ids"))
        lists = joins.collect_metadata(joins.with_metadata(rows, annotators))
        df = df.join(lists, schemas.ITEM, "left")
    df = with_targets(df, task) if task else cleaning.with_classes(df)
    return df.select(*[c for c in ITEM_COLUMNS if c in df.columns])


def read_annotators(spark: SparkSession, path: str | list[str], dataset: str) -> DataFrame:
    """A JSON object from annotator id to attributes, as one row per annotator."""
    rows = keyed_json.entries(spark, path, "map<string,string>")
    return rows.select(F.lit(dataset).alias("dataset"), F.col("key").alias("annotator_id"), F.col("value").alias("attrs"))


def math_items(df: DataFrame, dataset: str = "aime", split: str = "train") -> DataFrame:
    """A table of math problems as items."""
    from dissensus.operators import ordering

    numbered = ordering.running_total(df, [], [F.col("ID")], name="dataset_idx")
    return numbered.select(
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        "dataset_idx",
        "ID",
        F.col("Question").alias("text"),
        F.col("Answer").alias("target"),
    )


def flat_metadata(df: DataFrame, names: list[str], col: str = "metadata") -> DataFrame:
    """Attributes of a metadata map as columns."""
    return df.select("*", *[F.try_element_at(col, F.lit(n)).alias(n) for n in names])
