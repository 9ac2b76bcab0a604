"""Connected components of an edge table by hooking and contraction: as joins while there are many edges, the rest in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

LOCAL_EDGES = 1 << 18  # edges that one task finishes, 16 bytes each


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node it is linked with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(np.concatenate(a), np.concatenate(b))], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (a, b: long); the root is the smallest node it is linked with.

    Up to ``LOCAL_EDGES`` distinct edges are solved by one task in one job.  More go
    through rounds of joins: every node but a local minimum hooks to its smallest
    neighbour, the chains are shortened by pointer jumping, and edges are contracted
    to roots, until so few are left.  The driver plans a few jobs instead of a chain
    of them for each call, and holds no edges.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cur, labels = settled(ordered.distinct(), "edges"), None
    while cur.count() > LOCAL_EDGES:
        if labels is None:
            labels = settled(cur.select(F.col("a").alias("node")).union(cur.select("b")).distinct().withColumn("root", F.col("node")), "labels")
        parent = settled(cur.groupBy("b").agg(F.min("a").alias("p")), "parent")
        while True:
            up = parent.select(F.col("b").alias("_b"), F.col("p").alias("_p"))
            jumped = settled(parent.join(up, parent["p"] == up["_b"], "left").select("b", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")), "parent")
            parent = jumped.select("b", "p")
            if jumped.where("moved").isEmpty():
                break
        labels = _moved(labels, parent)
        left = cur.join(parent.select(F.col("b").alias("_a"), F.col("p").alias("_pa")), F.col("a") == F.col("_a"), "left")
        both = left.join(parent.select(F.col("b").alias("_b"), F.col("p").alias("_pb")), F.col("b") == F.col("_b"), "left")
        ends = both.select(F.coalesce("_pa", "a").alias("x"), F.coalesce("_pb", "b").alias("y")).where("x != y")
        cur = settled(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    rest = settled(cur.coalesce(1).mapInArrow(_solve, "node long, root long"), "labels")
    return rest if labels is None else _moved(labels, rest.select(F.col("node").alias("b"), F.col("root").alias("p")))


def _moved(labels: DataFrame, parent: DataFrame) -> DataFrame:
    return settled(labels.join(parent, labels["root"] == parent["b"], "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
