"""Exact duplicates by sorting the texts themselves, with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dissensus.session import configure, written

# A text that has more than this share of all rows is sorted in several places.
HOT_SHARE = 1e-3
PIECES = 64
# Characters of a text that splitters go by.
FRONT = 32


def normalised(text: Column) -> Column:
    """Lower-cased ``A-Z``; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # ``lower`` is fast, and the same where all characters are ASCII.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def common_marks(marks: DataFrame) -> DataFrame:
    """Hashes ``mark`` of more than HOT_SHARE of the rows, at most 1 / HOT_SHARE of them."""
    limit = max(marks.count() * HOT_SHARE, PIECES)
    return marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("mark")


def sorted_rows(docs: DataFrame, key: str, text: str, carried: dict[str, Column]) -> DataFrame:
    """Rows in the order of their texts, with ``carried`` columns and ``key, norm, piece,
    keep_id, group_size, place``: the last three are of the rows with an equal text that
    were sorted in the same place."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Texts that are equal have one mark. A clash of marks splits a text in vain, no more.
    mark = F.xxhash64(F.lower(content))
    common = common_marks(docs.select(mark.alias("mark"))).withColumn("common", F.lit(True))
    marked = docs.select(
        F.struct(*[c.alias(n) for n, c in carried.items()]).alias("row") if carried else F.lit(None).alias("row"),
        F.col(key).alias("key"),
        content.alias("content"),
        mark.alias("mark"),
        normalised(F.substring(content, 1, FRONT)).alias("front"),
    )
    piece = F.when(F.col("common"), F.pmod(F.xxhash64("key"), F.lit(PIECES))).otherwise(-1)
    split = marked.join(F.broadcast(common), "mark", "left").withColumn("piece", piece.cast("int")).drop("common")
    # Splitters go through the driver, so they are short: the text's front, then its
    # mark. Equal texts share both; the window compares the whole texts.
    ranged = split.repartitionByRange("front", "mark", "piece").withColumn("norm", normalised(F.col("content")))
    same = Window.partitionBy("front", "mark", "norm", "piece")
    newest = same.orderBy(F.col("key").desc_nulls_last())
    return ranged.select(
        "row",
        "key",
        "norm",
        "piece",
        F.first("key").over(newest).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        F.row_number().over(newest).alias("place"),
    )


def best_pieces(rows: DataFrame) -> DataFrame:
    """For texts sorted in several places: ``text_sha256, piece, best, best_piece, size``,
    from rows with the text in ``head``. They are sorted once more, again in full; there
    are at most PIECES / HOT_SHARE of them."""
    same = Window.partitionBy("head")
    newest = same.orderBy(F.col("keep_id").desc_nulls_last(), "piece")
    return rows.filter(F.col("head").isNotNull()).select(
        "text_sha256",
        "piece",
        F.first("keep_id").over(newest).alias("best"),
        F.first("piece").over(newest).alias("best_piece"),
        F.sum("group_size").over(same).alias("size"),
    )


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing ``A-Z``. The row with the
    largest key stays (a null key is the smallest); of rows that repeat that key too,
    exactly one is ``kept``. Null texts equal empty ones. Only the two columns are read;
    others, whatever their names, do not matter.

    Sampled splitters cut the range of texts, each part is sorted, and a window compares
    neighbours in full. A text of more than HOT_SHARE of all rows, of which there are at
    most 1 / HOT_SHARE, is sorted in PIECES places by a hash of the key; the first rows
    of those places are sorted and compared once more, again in full.
    """
    configure(docs.sparkSession)
    local = sorted_rows(docs, key, text, {}).select(
        "key", "piece", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", "place", head().alias("head")
    )
    local = written(local, "sorted-texts")
    # At most PIECES / HOT_SHARE rows of about 100 bytes.
    joined = local.drop("head").join(F.broadcast(best_pieces(local)), ["text_sha256", "piece"], "left")
    split = F.col("best_piece").isNotNull()
    return joined.select(
        F.col("key").alias(key),
        F.when(split, F.col("best")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("best_piece") == F.col("piece")))).alias("kept"),
        "text_sha256",
    )


def head() -> Column:
    """The text, on the first row of a text that is sorted in several places."""
    return F.when((F.col("piece") >= 0) & (F.col("place") == 1), F.col("norm"))


def keep_newest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, by the rules of ``groups``, with all their columns."""
    configure(docs.sparkSession)
    others = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    first = sorted_rows(docs, key, text, others).filter("place = 1").select(
        "row", "piece", "keep_id", "group_size",
        F.when(F.col("piece") >= 0, F.sha2("norm", 256)).alias("text_sha256"), head().alias("head"),
    )
    first = written(first, "first-rows")
    lost = best_pieces(first).filter("piece <> best_piece").select("text_sha256", "piece")
    # At most PIECES / HOT_SHARE rows of about 100 bytes.
    kept = first.join(F.broadcast(lost), ["text_sha256", "piece"], "left_anti")
    return kept.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
