"""Connected components of an edge table.

First every task contracts the edges it holds: each of its nodes is linked to the smallest
one that the task's own edges reach.  Tasks are sized by the measured number of edges, so
a table that fits one task is finished there.  Otherwise alternating star contraction goes
on from the contracted edges: each round replaces every node's larger neighbours' links by
links to its smallest neighbour (large star), then does the same with the smaller ones
(small star).  Both are a ``min`` aggregate, combined before the shuffle, and an equi-join
that adaptive execution splits where a star centre is hot; no node's neighbourhood is ever
gathered in a task.  The edge table is cut with a reliable checkpoint each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage


TASK_EDGES = 400_000  # edges contracted in one task: 6 MB


def _contract(batches):
    """(node, smallest node reached by this task's edges), the smallest itself left out."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        # hook the larger root of every open edge to the smaller, then flatten
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.flatnonzero(root != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[root[out]])], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    near = both.join(low, "u")
    if large:
        return near.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
    out = near.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(
        low.select("u", F.col("_m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)`` that has a neighbour, where
    component is the smallest node reachable; the component's own smallest node is left
    out (it is its own component).  Self loops, repeated edges and nulls are ignored."""
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = cut_lineage(edges.filter("u <> v"))
    tasks = -(-edges.count() // TASK_EDGES) or 1
    edges = cut_lineage(edges.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
    state = _state(edges) if tasks > 1 else None
    while state and state[0]:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
