"""Connected components of an undirected graph.

Each task contracts its share of the edges to a spanning forest with a small union-find, so that many edges
become at most one for each node it has seen; then each node points to its least neighbour, pointers are
followed twice, and what still joins different roots goes into the next round. The shares are bounded by the
partitioning, a hub's edges are reduced in each task before they meet, and nothing is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import Scratch


#: Edges that a task gathers before it contracts them.
HELD = 1 << 20


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to (node, root) with root < node, at most one a node."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    low = np.arange(len(nodes))
    while True:  # hook the greater root below the smaller one, then shorten all paths
        ra, rb = low[a], low[b]
        differ = ra != rb
        if not differ.any():
            break
        hi, lo = np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ]
        np.minimum.at(low, hi, lo)
        while (low[low] != low).any():
            low = low[low]
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


def _forest(batches):
    """Edges (a, b) of one task to its spanning forest; only the forest of what has passed and ``HELD`` edges, or as many as the forest, are held."""
    held, rows, most = [], 0, HELD
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
        if rows > most:
            held = [_contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            rows = len(held[0][0])
            most = max(HELD, 2 * rows)
    if held:
        node, root = _contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    ``edges``: columns a and b, long. Edges with a null end or from a node to itself are left out; repeated edges
    and either direction change nothing; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    live = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    step = 0
    while True:
        forest = live.mapInArrow(_forest, "node long, root long")
        if step:  # after the first round equal pairs of roots come from many tasks
            forest = forest.distinct()
        forest = scratch.keep(forest, f"forest{step}")
        if step:  # what led to this table is not read again
            scratch.drop(f"forest{step - 1}")
            scratch.drop(f"best{step - 1}")
        best = scratch.keep(forest.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")), f"best{step}")
        up = best.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # Open is what a further round must join: a node with two roots, or a root that has one itself.
        split = forest.join(best.where("root <> other").select("node", F.col("root").alias("least")), "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
        flat = best.join(up, "root", "left")
        if split.isEmpty() and flat.where(F.col("top").isNotNull()).isEmpty():
            return best.select("node", "root").union(best.select("root", F.col("root").alias("r")).distinct())
        jumped = flat.select(F.col("node").alias("a"), F.coalesce("top", "root").alias("b"))
        chain = flat.where(F.col("top").isNotNull()).select(F.col("root").alias("a"), F.col("top").alias("b"))
        live = jumped.union(split).union(chain).repartition("a")
        step += 1
