"""Throughput logs of a model server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissensus.functions import text


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def throughput(lines: DataFrame, value: str = "value") -> DataFrame:
    """Throughput lines as typed columns; lines of other kinds are left out."""
    line = F.col(value)
    kept = lines.where(F.contains(line, F.lit("Engine 000:")) & F.rlike(line, F.lit(text.LOG_LINE)))
    return kept.select(*[c for c in lines.columns if c != value], *text.log_fields(line))


def model_names(lines: DataFrame, value: str = "value") -> DataFrame:
    """Model of each file: the name in the file's first line that has one."""
    named = lines.where(F.contains(F.col(value), F.lit("model="))).withColumn(
        "__at", F.struct("block", F.monotonically_increasing_id().alias("i"))
    )
    return named.groupBy("file").agg(
        F.coalesce(F.min_by(text.log_model(F.col(value)), "__at"), F.lit("Unknown Model")).alias("model")
    )
