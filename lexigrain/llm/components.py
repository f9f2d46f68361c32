"""Connected components of an edge table, without collecting anything.

Tasks of a bounded number of edges first join what they hold by union-find; few
enough edges are one task and end there.  What several tasks have left is
joined by alternating large and small stars.  A round of those is several
statements with joins, and the driver keeps something of each statement, so
there are no more rounds than it takes to get a forest of stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.skew import join_unique
from lexigrain.llm.worker import serving
from lexigrain.storage import materialize, release

#: Edges that a task joins by itself, about: some 100 MB of its worker.
EDGES_PER_TASK = 1 << 20


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of every node that these edges join with a smaller one; component is the least that they reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            break
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        # Parents are roots here; each goes below the least root beside it, so there are no cycles.
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


@serving("components")
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches if batch.num_rows]
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_joined(*np.concatenate(own, axis=1))], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_unique(both, least, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Each edge from its larger end; every smaller neighbour and the node itself go to the least of them.
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # What the large star leaves has few neighbours below each node; no key of these is hot.
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node with an edge down (a > b) has no other edge: then each b is the least of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (long a, long b) that has an edge to another, component being the least node reachable; self-edges are ignored.

    Up to EDGES_PER_TASK edges take two tables, whatever the graph; beyond it
    rounds go on until there are only stars, about the square of the logarithm
    of the longest path that the tasks have left.
    """
    given = hasattr(edges, "_table_path")
    now = edges if given else materialize(edges.filter("a <> b").select("a", "b"), "edges")
    tasks = math.ceil(now.count() / EDGES_PER_TASK)
    parts = now.filter("a <> b").select("a", "b")
    parts = parts.coalesce(1) if tasks < 2 else parts.repartition(tasks)
    joined = materialize(parts.mapInArrow(_joined, "a long, b long"), "edges")
    if not given:
        release(now)
    now = joined
    while tasks > 1 and not _stars(now):
        nxt = materialize(_small_star(_large_star(now)), "edges")
        release(now)
        now = nxt
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
