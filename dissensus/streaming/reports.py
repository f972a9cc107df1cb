"""Structured Streaming forms of the progress report, the dedupe and the log report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dissensus.session import scratch_folder
from dissensus.sources import logs


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream. ``path`` may also be one file."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(jvm_path).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def answer_stream(
    spark: SparkSession, folder: str, schema, name: str = "*.json*", max_files: int | None = None
) -> DataFrame:
    """Answers that are appended below a folder as JSON lines."""
    reader = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("recursiveFileLookup", True)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def progress(stream: DataFrame, keys: list[str], valid: str = "is_valid_pred", loss: str = "ws_loss") -> DataFrame:
    """Validity and mean loss so far by run settings; the state is one row per setting."""
    return stream.groupBy(*keys).agg(
        F.avg(F.col(valid).cast("int")).alias("is_valid_pred"),
        F.count(valid).alias("validity_count"),
        F.avg(F.when(F.col(valid), F.col(loss))).alias("avg_ws_loss"),
        F.count(F.when(F.col(valid), F.col(loss))).alias("loss_count"),
    )


def distinct_answers(stream: DataFrame, keys: list[str], time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Drop repeated answers that arrive within the delay; older keys leave the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def throughput_windows(
    stream: DataFrame, keys: list[str], value: str, time: str = "timestamp", delay: str = "10 minutes", width: str = "1 minute"
) -> DataFrame:
    """Mean and maximum of a throughput per time window."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, width).alias("w"))
        .agg(
            F.avg(value).alias(f"avg_{value}"),
            F.max(value).alias(f"max_{value}"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(*keys, F.col("w.start").alias("start"), f"avg_{value}", f"max_{value}", "n")
    )


def active_periods(
    stream: DataFrame, keys: list[str], value: str, time: str = "timestamp", delay: str = "10 minutes", gap: str = "5 minutes"
) -> DataFrame:
    """Periods of activity that a gap without lines ends."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.session_window(time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"avg_{value}"))
        .select(
            *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", f"avg_{value}"
        )
    )


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Typed throughput lines of logs that are appended below a folder."""
    return logs.throughput(spark.readStream.text(folder))


def run_to_table(
    stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, folder: str | None = None
) -> DataFrame:
    """Process all that has arrived and return the result table.

    With a ``folder`` of an earlier run the stream goes on from that run's state, and
    only what arrived since is read; the table is that of all runs. Without one it
    starts anew. The sink is a Parquet folder below the shared scratch folder. In ``update``
    mode every batch writes the rows it changed, and the table keeps the latest row
    of each key. In ``complete`` mode every batch writes the whole result, and the
    table is that of the last one; groups that are still open are in it.
    """
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/state"
    )
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.foreachBatch(write_batch(f"{folder}/rows")).start()
    query.awaitTermination()
    schema = stream.schema
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{folder}/rows")
    schema = StructType([*schema.fields, StructField("__batch", LongType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)
    if mode == "complete":
        last = rows.agg(F.max("__batch")).first()[0]
        return rows.where(F.col("__batch") == F.lit(last)).drop("__batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "__batch").alias("__v")
    ).select(*keys, "__v.*")


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        df.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
            f"{path}/part_batch={batch}"
        )

    return write
