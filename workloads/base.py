"""Registry of queries, and the views over the given tables they start from.

Every view exists twice: as a DataFrame for Spark and as a common table
expression for the SQL check.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dissensus import session


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[["Tables"], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views of CTES by name."""

    def add(fn: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = Query(name, tuple(covers.split()), fn, with_ctes(sql) if sql else None)
        return fn

    return add


def r6(col, digits: int = 6) -> Column:
    return F.round(col if isinstance(col, Column) else F.col(col), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of a sum does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def long_vector(df: DataFrame, keys: list[str], col: str = "pred") -> DataFrame:
    """A vector column as rows of (keys, class_idx, prob)."""
    # The outer form: for the inner one Spark adds a filter on the array's size, which
    # is pushed below and computes the vector a second time.
    return df.select(*keys, F.posexplode_outer(col).alias("class_idx", "prob")).select(
        *keys, "class_idx", r6(F.col("prob")).alias("prob")
    )


# Tables that the costly column functions read.
SPREAD = {"lineitem", "orders", "documents", "events", "embeddings", "conversations"}


@dataclass
class Tables:
    """The given tables, and views of them in the shape of items, answers and grades."""

    spark: SparkSession
    folder: str
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        session.configure(self.spark)
        self.folder = self.folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        """A table; one of few row groups is spread over the cores, as a scan of it
        would keep them idle. A large table has row groups for all of them."""
        df = self.spark.read.parquet(self.path(name))
        cores = self.spark.sparkContext.defaultParallelism
        # Partitions of the scan: files are cut at a size, not at row groups.
        small = name in SPREAD and df.rdd.getNumPartitions() < cores
        return df.repartition(cores) if small else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = VIEWS[name](self) if name in VIEWS else self.read(name)
        return self.made[name]


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {}
CTES: dict[str, str] = {}


def view(name: str, sql: str):
    def add(fn):
        VIEWS[name] = fn
        CTES[name] = sql
        return fn

    return add


def with_ctes(sql: str) -> str:
    """Put the views a statement uses in front of it, in the order of their definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    own = sql.strip()
    if not parts:
        return own
    if own[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + own[5:]
    return "WITH " + ",\n".join(parts) + "\n" + own


# --- answers: one row per line item -------------------------------------------------

@view(
    "answers",
    """
    SELECT CASE l_returnflag WHEN 'A' THEN 'CSC' WHEN 'N' THEN 'MP' ELSE 'Paraphrase' END AS dataset,
           CASE l_linestatus WHEN 'F' THEN 'train' ELSE 'dev' END AS split,
           l_orderkey AS dataset_idx, CAST(l_linenumber - 1 AS INTEGER) AS run_idx,
           CASE WHEN l_partkey % 2 = 0 THEN 'Qwen/Qwen3-32B' ELSE 'Qwen/Qwen3-14B' END AS model_id,
           CASE WHEN l_tax < 0.035 THEN 31 ELSE 60 END AS template_id,
           CASE WHEN l_quantity < 25 THEN 'thinking' ELSE 'set2' END AS gen_kwargs,
           l_partkey AS part, l_suppkey AS annotator, l_extendedprice AS score, l_shipdate AS ts,
           CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS t,
           CAST(l_quantity AS INTEGER) AS q,
           concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                     CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),
                     CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS rid
    FROM lineitem
    """,
)
def answers(t: Tables) -> DataFrame:
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "A", "CSC").when(F.col("l_returnflag") == "N", "MP")
        .otherwise("Paraphrase").alias("dataset"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("dev").alias("split"),
        F.col("l_orderkey").alias("dataset_idx"),
        (F.col("l_linenumber") - 1).cast("int").alias("run_idx"),
        F.when(F.col("l_partkey") % 2 == 0, "Qwen/Qwen3-32B").otherwise("Qwen/Qwen3-14B").alias("model_id"),
        F.when(F.col("l_tax") < 0.035, 31).otherwise(60).alias("template_id"),
        F.when(F.col("l_quantity") < 25, "thinking").otherwise("set2").alias("gen_kwargs"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("annotator"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_shipdate").alias("ts"),
        hundredths("l_discount").alias("d"),
        hundredths("l_tax").alias("t"),
        F.col("l_quantity").cast("int").alias("q"),
        F.concat_ws(
            "|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("int").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("rid"),
    )


# One integer label per answer, and the label it should have been.
@view(
    "labelled",
    """
    SELECT *, CASE dataset WHEN 'CSC' THEN 1 + (q - 1) % 6 WHEN 'MP' THEN d % 2 ELSE d - 5 END AS pred,
           CASE dataset WHEN 'CSC' THEN 1 + t % 6 WHEN 'MP' THEN t % 2 ELSE t - 4 END AS target,
           CASE dataset WHEN 'CSC' THEN 7 WHEN 'MP' THEN 2 ELSE 11 END AS n_classes,
           CASE dataset WHEN 'Paraphrase' THEN 5 ELSE 0 END AS off
    FROM answers
    """,
)
def labelled(t: Tables) -> DataFrame:
    d, tax, q, name = F.col("d"), F.col("t"), F.col("q"), F.col("dataset")
    return t.answers.withColumns(
        {
            "pred": F.when(name == "CSC", 1 + (q - 1) % 6).when(name == "MP", d % 2).otherwise(d - 5),
            "target": F.when(name == "CSC", 1 + tax % 6).when(name == "MP", tax % 2).otherwise(tax - 4),
            "n_classes": F.when(name == "CSC", 7).when(name == "MP", 2).otherwise(11),
        }
    )


# Up to three (class, hundredths) masses per answer, which make up its distribution.
@view(
    "masses",
    """
    SELECT *, CASE dataset WHEN 'CSC' THEN 1 + (q - 1) % 6 WHEN 'MP' THEN 0 ELSE d END AS c1,
           CASE dataset WHEN 'CSC' THEN 6 WHEN 'MP' THEN 1 ELSE 10 - t END AS c2,
           CASE dataset WHEN 'CSC' THEN 1 ELSE 0 END AS c3,
           CASE dataset WHEN 'CSC' THEN 100 - 5 * d - 4 * t WHEN 'MP' THEN 100 - 10 * d ELSE 100 - 6 * t END AS m1,
           CASE dataset WHEN 'CSC' THEN 5 * d WHEN 'MP' THEN 10 * d ELSE 6 * t END AS m2,
           CASE dataset WHEN 'CSC' THEN 4 * t ELSE 0 END AS m3
    FROM labelled
    """,
)
def masses(t: Tables) -> DataFrame:
    d, tax, q, name = F.col("d"), F.col("t"), F.col("q"), F.col("dataset")
    csc, mp = name == "CSC", name == "MP"
    return t.labelled.withColumns(
        {
            "c1": F.when(csc, 1 + (q - 1) % 6).when(mp, 0).otherwise(d),
            "c2": F.when(csc, 6).when(mp, 1).otherwise(10 - tax),
            "c3": F.when(csc, 1).otherwise(0),
            "m1": F.when(csc, 100 - 5 * d - 4 * tax).when(mp, 100 - 10 * d).otherwise(100 - 6 * tax),
            "m2": F.when(csc, 5 * d).when(mp, 10 * d).otherwise(6 * tax),
            "m3": F.when(csc, 4 * tax).otherwise(0),
        }
    )


@view(
    "soft",
    """
    SELECT m.*, k.k AS class_idx,
           ((CASE WHEN k.k = c1 THEN m1 ELSE 0 END) + (CASE WHEN k.k = c2 THEN m2 ELSE 0 END)
            + (CASE WHEN k.k = c3 THEN m3 ELSE 0 END)) / 100.0::DOUBLE AS p
    FROM masses m, range(11) k(k) WHERE k.k < n_classes
    """,
)
def soft(t: Tables) -> DataFrame:
    """Answers with a distribution ``pred`` and the label of ``masses`` as ``label``."""
    part = lambda k, i: F.when(F.col(f"c{i}") == k, F.col(f"m{i}")).otherwise(0)
    vector = F.transform(
        F.sequence(F.lit(0), F.col("n_classes") - 1),
        lambda k: (part(k, 1) + part(k, 2) + part(k, 3)) / F.lit(100.0),
    )
    return t.masses.withColumnRenamed("pred", "label").withColumn("pred", vector).drop(
        "c1", "c2", "c3", "m1", "m2", "m3"
    )


# Target distribution of an item: the shares of its target labels.
@view(
    "targets",
    """
    SELECT l.dataset, l.split, l.dataset_idx, l.n_classes, k.k AS class_idx,
           count(*) FILTER (l.target + l.off = k.k) / count(*)::DOUBLE AS target
    FROM labelled l, range(11) k(k) WHERE k.k < l.n_classes
    GROUP BY ALL
    """,
)
def targets(t: Tables) -> DataFrame:
    from dissensus import registry
    from dissensus.operators import distributions
    from dissensus.schemas import ITEM

    shares = distributions.soft_labels(t.labelled, ITEM, col="target", name="target")
    return shares.withColumn("n_classes", registry.n_classes(F.col("dataset")))


# Answers joined to their item, with the distance of every row.
@view(
    "pairs",
    """
    SELECT s.dataset, s.split, s.dataset_idx, s.run_idx, s.rid, s.model_id, s.template_id, s.gen_kwargs,
           s.n_classes, s.score, s.class_idx, s.p, g.target
    FROM soft s JOIN targets g USING (dataset, split, dataset_idx, n_classes, class_idx)
    """,
)
def pairs(t: Tables) -> DataFrame:
    from dissensus.operators import joins

    columns = ["dataset", "split", "dataset_idx", "run_idx", "rid", "model_id", "template_id",
               "gen_kwargs", "n_classes", "score", "pred"]
    return joins.join_items(t.soft.select(*columns), t.targets)


@view(
    "scored",
    """
    SELECT dataset, split, dataset_idx, run_idx, rid, model_id, template_id, gen_kwargs, n_classes, score,
           sum(abs(gap)) AS ws_loss, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS pred_entropy
    FROM (SELECT *, sum(p - target) OVER (PARTITION BY rid, dataset, split ORDER BY class_idx) AS gap FROM pairs)
    GROUP BY ALL
    """,
)
def scored(t: Tables) -> DataFrame:
    from dissensus.operators import metrics

    return metrics.with_soft_metrics(t.pairs)
