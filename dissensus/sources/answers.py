"""Model answers: JSON lines or Parquet in, JSON lines or Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissensus import schemas
from dissensus.functions import text
from dissensus.operators import cleaning


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Answers from a folder of Parquet files whose columns may differ."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return cleaning.recompute_success(df)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Answers from listed Parquet files or globs whose columns may differ."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_with_file(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``read_files``, with the file a row comes from."""
    df = read_files(spark, paths)
    return df.withColumn("preds_file", F.col("_metadata.file_path"))


def read_json_lines(spark: SparkSession, folder: str, name: str = "responses.jsonl", schema: str = schemas.PREDICTIONS) -> DataFrame:
    """Answers from all files of one name below a folder."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(folder)
    )


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JUDGEMENTS).json(path)


def json_to_parquet(spark: SparkSession, source: str, target: str, schema: str = schemas.PREDICTIONS) -> None:
    """JSON lines, a file or a glob, to Parquet."""
    spark.read.schema(schema).json(source).write.parquet(target)


def gather_to_parquet(spark: SparkSession, folder: str, target: str) -> None:
    """All gathered answer files to one Parquet table partitioned by dataset and split."""
    read_json_lines(spark, folder).write.partitionBy("dataset", "split").parquet(target)


def append_answers(df: DataFrame, path: str) -> None:
    """Append answers as JSON lines, stamped with the time."""
    stamped = df.drop("safety_settings").withColumn("timestamp", F.current_timestamp())
    stamped.write.mode("append").json(path)


def write_columns(df: DataFrame, path: str) -> None:
    """Per-annotator labels with their key, and the target where there is one."""
    names = [*schemas.ITEM, "annotator_ids", "pred", "target"]
    df.select(*[c for c in names if c in df.columns]).write.parquet(path)


def subset(df: DataFrame, ids: DataFrame, key: str = "dataset_idx") -> DataFrame:
    """Answers to the items of an id table.

    A task holds its share of the distinct ids as a hash table, so that the answers, whole
    rows, are not sorted.
    """
    return df.join(ids.select(key).distinct().hint("shuffle_hash"), key, "left_semi")


def write_subset(df: DataFrame, ids: DataFrame, path: str, key: str = "dataset_idx") -> None:
    subset(df, ids, key).write.parquet(path)


# Columns of a batch service's file that an answer does not have.
SERVICE_COLUMNS = ["status", "processed_time", "request"]


def from_batch_service(df: DataFrame) -> DataFrame:
    """Answers of a batch service, with its nested response taken apart."""
    candidate = F.get(F.col("response.candidates"), F.lit(0))
    parts = candidate["content"]["parts"]
    return df.withColumns(
        {
            "reasoning": text.first_part(parts, thought=True),
            "success": F.coalesce(candidate["finishReason"] == "STOP", F.lit(False)),
            "response": text.first_part(parts, thought=False),
        }
    ).drop(*SERVICE_COLUMNS)


def convert_batch_service(spark: SparkSession, source: str, target: str) -> None:
    from_batch_service(spark.read.schema(schemas.BATCH_RESPONSES).json(source)).write.json(target)


def catalogue(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """Expected runs with a flag whether there are answers for them."""
    keys = [c for c in expected.columns if c in answers.columns]
    present = answers.select(*keys).distinct().withColumn("exists", F.lit(True))
    return expected.join(present, keys, "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def expected_runs(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the given settings, one column each."""
    df = spark.range(1).select()
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return df


def write_csv(df: DataFrame, path: str, digits: int = 3) -> None:
    """A result table with rounded numbers, as CSV with a header."""
    rounded = [
        F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
        for n, t in df.dtypes
    ]
    df.select(*rounded).write.option("header", True).csv(path)
