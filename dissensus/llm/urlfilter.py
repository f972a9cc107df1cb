"""URL rules and lists, by a blocked Bloom filter in front of an exact join."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissensus.session import configure, written

BITS_PER_KEY = 16
WORDS = 8  # 64-bit words of a block; a key sets one bit in each
# 64 bytes a block: the filter never has more than 32 MB, however long the list is. A
# fuller filter passes more keys on to the join, whose result is the same.
MAX_BLOCKS = 1 << 19


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host stands after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, with ``A-Z`` lower-cased, the path from there to ``?``, ``#`` or the end.
    Both are empty for null and for a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One form of the addresses of a page: no scheme, query, ``www.`` or last ``/``."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def hashed(keys: DataFrame) -> DataFrame:
    """``keys`` with the two hashes a filter works with."""
    return keys.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1))})


class Blocks:
    """A filter: for each key one block, and in each of its words one bit."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> "Blocks":
        """Built by an aggregate that ORs the bits of a block; ``key`` is not null."""
        n = keys.count()
        blocks = int(min(MAX_BLOCKS, max(1, n * BITS_PER_KEY // (64 * WORDS))))
        rows = hashed(keys).select(F.pmod("h1", F.lit(blocks)).alias("block"), "h2")
        bit = lambda k: F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftright(h2, {6 * k}) & 63 AS INT))"))
        made = rows.groupBy("block").agg(*[bit(k).alias(f"w{k}") for k in range(WORDS)])
        words = np.zeros((blocks, WORDS), dtype=np.uint64)
        # In one job and as columns; the rows are no more than the blocks.
        found = made.toArrow()
        at = found.column("block").to_numpy()
        for k in range(WORDS):
            words[at, k] = found.column(f"w{k}").to_numpy().view(np.uint64)
        return cls(words)

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        held = self.words[h1 % np.int64(len(self.words))]
        shift = (h2[:, None] >> (np.arange(WORDS) * 6)) & 63
        return ((held >> shift.astype(np.uint64)) & np.uint64(1)).all(axis=1)


def possible(keys: DataFrame, blocks: Blocks) -> DataFrame:
    """The rows whose ``key`` the filter may hold: all that it does, and a few others."""
    # At most 64 * MAX_BLOCKS bytes.
    shared = keys.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            yield batch.filter(pa.array(shared.value.may_hold(h1, h2))).select(names)

    names = keys.columns
    return hashed(keys).mapInArrow(run, keys.schema)


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs such as ("block", "example.org/es/") as a table."""
    schema = "key string, verdict string"
    return spark.createDataFrame([(rule, verdict) for verdict, rule in rules], schema)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, listed``, one row per page, repeated rows included.

    ``rules``: ``key`` (a host and the beginning of a path, ``net/``) and ``verdict``. A
    rule fits its host and all subdomains if the path starts with the rule's. The longest
    rule that fits gives the verdict; among rules of one length the first in order.
    Without a rule, pages whose canonical address is in ``listed`` (column ``key``) are
    blocked, others allowed. Rules and list may be empty, null keys in them are ignored.

    Every address stands for a few keys: each suffix of its host with each beginning of
    its path that is as long as some rule's. The filter passes on those that may be in
    the table, a hash join finds those that are.
    """
    configure(pages.sparkSession)
    host, path = parts(F.col(url).cast("string"))
    pages = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rules = rules.filter("key IS NOT NULL").groupBy("key").agg(F.max("verdict").alias("verdict"))
    entries = rules.select("key", F.lit("rule").alias("kind"), "verdict").unionByName(
        listed.filter("key IS NOT NULL").select("key").distinct().select("key", F.lit("list").alias("kind"), F.lit("block").alias("verdict"))
    )
    entries = written(entries, "url-entries")
    # Lengths of the rules' paths: a few numbers. An address has at most 2048 or so.
    lengths = F.length("key") - F.instr("key", "/") + 1
    sizes = [r[0] for r in rules.filter(F.instr("key", "/") > 0).select(lengths).distinct().orderBy(F.lit(1)).collect()]
    blocks = Blocks.of(entries.select(F.concat("kind", F.lit(" "), "key").alias("key")))
    # The list holds addresses without a host too, such as file:///x.
    urls = pages.filter("host <> '' OR path <> ''").select("host", "path").distinct()
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    fits = F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.length("path"))
    begun = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.concat(F.lit("rule "), s, F.substring("path", F.lit(1), n)))))
    own = F.array(F.concat(F.lit("list "), canonical(F.col("host"), F.col("path"))))
    keys = urls.select("host", "path", F.explode(F.concat(begun, own)).alias("key"))
    hits = possible(keys, blocks).select(
        "host", "path", F.split("key", " ", 2)[0].alias("kind"), F.split("key", " ", 2)[1].alias("key")
    )
    exact = hits.join(entries, ["kind", "key"])
    best = F.min(F.when(F.col("kind") == "rule", F.struct((-F.length("key")).alias("n"), F.col("key").alias("k"), F.col("verdict").alias("v"))))
    found = exact.groupBy("host", "path").agg(best.alias("best"), F.max(F.col("kind") == "list").alias("listed"))
    joined = pages.join(found, ["host", "path"], "left")
    is_listed = F.coalesce("listed", F.lit(False))
    return joined.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("best")["k"].alias("rule"),
        F.coalesce(F.col("best")["v"], F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
        is_listed.alias("listed"),
    )


def repeated(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical addresses that more than one page has, as a list to block."""
    host, path = parts(F.col(url).cast("string"))
    keys = pages.select(canonical(host, path).alias("key")).filter("key <> ''")
    return keys.groupBy("key").count().filter("count > 1").select("key")
