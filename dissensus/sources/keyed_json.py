"""Files that are one JSON object from key to value, read by many tasks.

Spark's text reader cuts a file at byte ranges, here into fragments that end with a
closing brace. Whether a fragment starts inside a string, and how deep, follows from all
before it in the file: both are running sums, first within a byte range, then over the
ranges of a file (one small row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from dissensus.operators import ordering
from dissensus.session import written

RANGE = ["path", "block"]

def in_range(end: int) -> WindowSpec:
    """All fragments of a byte range up to one (0), or before it (-1)."""
    return Window.partitionBy(*RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, end)


def ranges_before() -> WindowSpec:
    """All byte ranges before one, in its file."""
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def entries(spark: SparkSession, path: str | list[str], value_type: str) -> DataFrame:
    """``key, value`` of every entry of the objects in the files.

    Values that are not of the type are null. A key that a file repeats gives a row each
    time. Empty files and empty objects give none. A file that is not one JSON object
    gives no rows, or those of the entries that can be told apart. No file or byte range
    is held in memory; one entry is.
    """
    texts = entry_texts(fragments(spark, path))
    parsed = F.from_json("text", f"map<string,{value_type}>")
    return texts.select(F.explode(parsed).alias("key", "value"))


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, block, pos, value``: the text between closing braces, by byte range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def without_strings(text: Column) -> Column:
    return F.regexp_replace(text, r'"[^"]*("|$)', "")


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def with_depth(pieces: DataFrame) -> DataFrame:
    """Add ``outside`` (the fragment starts outside of strings), ``depth`` before the
    fragment and ``after`` it.

    A closing brace cannot be escaped, so no escape reaches over the end of a fragment.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = count_of(plain, '"')
    # Opened less closed braces, where the fragment starts outside or inside a string.
    # Its own closing brace counts if it ends outside.
    opened = [without_strings(plain), without_strings(F.concat(F.lit('"'), plain))]
    df = pieces.withColumns({
        "q": quotes % 2,
        "d0": count_of(opened[0], "{") - F.when(quotes % 2 == 0, 1).otherwise(0),
        "d1": count_of(opened[1], "{") - F.when(quotes % 2 == 1, 1).otherwise(0),
    })
    turned = F.coalesce(F.sum("q").over(in_range(-1)), F.lit(0)) % 2
    df = df.withColumn("turned", turned).withColumns({
        "d0": F.when(F.col("turned") == 0, F.col("d0")).otherwise(F.col("d1")),
        "d1": F.when(F.col("turned") == 0, F.col("d1")).otherwise(F.col("d0")),
    })
    ranges = df.groupBy(*RANGE).agg(*[F.sum(c).alias(f"all_{c}") for c in ("q", "d0", "d1")])
    inside = F.coalesce(F.sum("all_q").over(ranges_before()), F.lit(0)) % 2
    ranges = ranges.withColumn("inside", inside)
    deeper = F.when(F.col("inside") == 0, F.col("all_d0")).otherwise(F.col("all_d1"))
    ranges = ranges.withColumn("deeper", deeper)
    start = F.coalesce(F.sum("deeper").over(ranges_before()), F.lit(0))
    ranges = ranges.select(*RANGE, "inside", start.alias("start"))
    change = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    df = df.join(ranges, RANGE).withColumn("change", change)
    depth = F.col("start") + F.coalesce(F.sum("change").over(in_range(-1)), F.lit(0))
    df = df.withColumns({"outside": (F.col("turned") + F.col("inside")) % 2 == 0, "depth": depth})
    return df.select(*RANGE, "pos", "value", "outside", "depth", (F.col("depth") + F.col("change")).alias("after"))


def entry_texts(pieces: DataFrame) -> DataFrame:
    """``text``: an object of one entry, or of one and the scalar entries before it."""
    df = with_depth(pieces)
    starts = F.col("outside") & (F.col("depth") <= 1)
    df = df.withColumn("first", F.max(F.when(starts, F.col("pos"))).over(in_range(0)))
    # A range may begin within an entry: it goes to the last one that began before.
    last = df.groupBy(*RANGE).agg(F.max("first").alias("first"))
    begun = F.when(F.col("first").isNotNull(), F.struct("block", "first"))
    last = last.select(*RANGE, F.last(begun, ignorenulls=True).over(ranges_before()).alias("earlier"))
    df = df.join(last, RANGE)
    own = F.struct("block", "first")
    df = df.withColumn("entry", F.when(F.col("first").isNotNull(), own).otherwise(F.col("earlier")))
    whole = df.groupBy("path", "entry").agg(
        F.sort_array(F.collect_list(F.struct("block", "pos", "value"))).alias("parts"), F.min("after").alias("after")
    )
    joined = F.concat(F.array_join(F.col("parts.value"), "}"), F.lit("}"))
    text = F.regexp_replace(joined, r"^[\s,\uFEFF]*\{?\s*", "")
    closing = F.when(F.col("after") > 0, "}").otherwise("")
    return whole.select(text.alias("text"), closing.alias("closing")).where(F.startswith("text", F.lit('"'))).select(
        F.concat(F.lit("{"), "text", "closing").alias("text")
    )


def write(df: DataFrame, path: str, per_file: int = 100_000) -> None:
    """``key, value`` as files of one JSON object each, of at most ``per_file`` entries.

    Entries are in the order of their keys, a line each; no file is held in memory.
    Null keys have no place in an object and are left out. No rows make no files.
    """
    placed = ordering.running_total(df.where(F.col("key").isNotNull()), [], [F.col("key")], name="pos")
    name = F.to_json(F.array(F.col("key").cast("string")))
    line = F.concat(
        F.when(F.col("pos") % per_file == 0, "{").otherwise(","), F.substring(name, F.lit(2), F.length(name) - 2),
        F.lit(":"), F.coalesce(F.to_json("value"), F.lit("null")),
    )
    file = F.floor(F.col("pos") / per_file).alias("file")
    lines = written(placed.select(file, "pos", line.alias("line")), "keyed-lines")
    ends = lines.groupBy("file").agg((F.max("pos") + 1).alias("pos"), F.lit("}").alias("line"))
    every = lines.unionByName(ends).repartition("file").sortWithinPartitions("file", "pos")
    every.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
