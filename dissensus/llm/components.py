"""Connected components of a table of links: tasks unite the links they hold, then joins
and aggregates unite what the tasks found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissensus.session import written

# Links that a task holds at once, about 100 bytes each. Up to so many need no rounds.
TASK_LINKS = 1 << 18


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers below ``n`` the smallest one that the links u, v lead to."""
    root = np.arange(n)
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return root
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        # Larger roots go to the smallest root they meet, then all nodes to their roots.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def united(edges: DataFrame, links: int, loops: bool = False) -> DataFrame:
    """Links ``u, v`` with the same components as ``edges``: those within slices of
    ``links`` links of a task, each node linked to the smallest one of its component.
    ``loops``: that one is linked to itself."""

    def run(batches):
        held, size = [], 0

        def out():
            table = pa.Table.from_batches(held)
            nodes = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks()
            codes = nodes.dictionary_encode()
            order = pc.sort_indices(codes.dictionary)  # of the distinct nodes
            place = np.empty(len(order), dtype=np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            at = place[codes.indices.to_numpy()]
            root = forest(at[: len(table)], at[len(table) :], len(order))
            some = np.flatnonzero(loops | (root != np.arange(len(root))))
            names = codes.dictionary.take(order)
            return pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(root[some]))], names=["u", "v"])

        for batch in batches:
            for lo in range(0, batch.num_rows, links):
                part = batch.slice(lo, links)
                if held and size + part.num_rows > links:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield out()

    return edges.mapInArrow(run, edges.schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; the root is the smallest node it reaches.

    Tasks unite the links they hold, in slices of bounded size. If all links fit in one
    slice, that is the result. Else rounds of two steps move all links to the smallest
    neighbours: larger neighbours of a node are linked to its smallest one, then smaller
    ones. The number of rounds grows with the logarithm of the longest chain. Each round
    is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    # Tasks in proportion to the links, each of one slice or so.
    edges = written(edges, "links")
    n = edges.count()
    if n <= TASK_LINKS:
        return written(united(edges.coalesce(1), TASK_LINKS, loops=True), "links").toDF("node", "root")
    edges = written(united(edges.coalesce(-(-n // TASK_LINKS)), TASK_LINKS).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
