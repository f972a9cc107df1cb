"""Solutions whose steps people have rated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissensus import schemas
from dissensus.functions import vectors


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rated solutions from JSON lines; the id follows from the content."""
    df = spark.read.schema(schemas.STEP_RATED).json(path)
    return df.withColumn("dataset_idx", F.xxhash64(F.to_json("question"), F.to_json("label")))


def solutions(df: DataFrame) -> DataFrame:
    """One row per solution: problem, step texts, ratings, and whether it is correct.

    Solutions a rater gave up on are left out. The first completion of a step counts.
    """
    steps = F.transform("label.steps", lambda s: F.get(s["completions"], F.lit(0)))
    rated = df.where(F.col("label.finish_reason") != "give_up").withColumn("__s", steps)
    ratings = F.transform("__s", lambda s: s["rating"])
    return rated.select(
        "dataset_idx",
        F.md5("question.problem").alias("problem_id"),
        F.col("question.problem").alias("problem"),
        F.transform("__s", lambda s: s["text"]).alias("texts"),
        ratings.alias("ratings"),
        vectors.mean(ratings).alias("avg_rating"),
        F.exists(ratings, lambda r: r < 0).alias("any_negative_rating"),
        F.size(ratings).alias("n_ratings"),
        F.col("question.ground_truth_answer").alias("target"),
        F.col("question.pre_generated_answer").alias("pred"),
        (F.col("label.finish_reason") == "solution").alias("correct"),
        F.col("question.ground_truth_solution").alias("solution"),
    )


def difficulty(df: DataFrame, key: str = "problem_id") -> DataFrame:
    """Share of correct solutions of each problem, and how many there are."""
    return df.groupBy(key).agg(
        F.avg(F.col("correct").cast("int")).alias("correct"),
        F.count("correct").alias("n_solutions"),
    )


def hard_problems(df: DataFrame, key: str = "problem_id") -> DataFrame:
    """Problems without any correct solution, as items."""
    hard = df.groupBy(key).agg(F.max(F.col("correct").cast("int")).alias("m")).where("m = 0")
    return (
        df.join(hard.select(key), key, "left_semi")
        .select(key, F.col("problem").alias("text"), "target")
        .dropDuplicates()
    )
