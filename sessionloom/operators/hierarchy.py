"""Parent-child links to full hierarchies (problem 4).

The links are cut into fragments, one or more for each shuffle partition, by ranges of the ids, since children are mostly
made soon after their parents. Inside a fragment every chain of parents is contracted to the first parent that lies
outside (its exit). The exits alone form a smaller forest, the quotient, which is solved the same way, with children
moved beside their parents; then each fragment's rows take over root, depth and path of their exit. Only a quotient
of few rows is one fragment. A chain that never leaves its fragment and meets no root runs into a loop: a loop inside
one fragment is seen there, a longer one in the quotient in which it has shrunk into one fragment.

Rows and results
    ``node_id`` string, ``parent_id`` string or null. Rows of a null node are left out, of several rows of one
    node that with the greatest parent stays (links first). A parent without a row of its own is no parent: the
    node is a root with ``dangling`` true. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.runtime import Scratch

#: Rows that one task holds at most while it contracts a fragment.
FRAGMENT_ROWS = 500_000
#: A quotient of at most so many rows is one fragment.
QUOTIENT_ROWS = 10_000

_LINKS = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("next_id", T.StringType()),
    T.StructField("steps", T.LongType()), T.StructField("low", T.StringType()),
    T.StructField("root_id", T.StringType()), T.StructField("depth", T.LongType()),
    T.StructField("loop_id", T.StringType()), T.StructField("seg", T.ArrayType(T.StringType())),
])


def _contract(with_paths: bool):
    """Contracts the links of one fragment.

    In: next_id null means resolved (root_id, depth, loop_id hold). Out: the same columns; a row whose next_id is
    not null leaves the fragment there after ``steps`` steps. ``low`` is the least id passed, which names loops;
    ``seg`` has the ids from below the exit down to the node, or from the root down where it is resolved.
    """

    def run(frames):
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        t = pd.concat(parts, ignore_index=True)
        n = len(t)
        ids, nxt_id = t.node_id.to_numpy(object), t.next_id.to_numpy(object)
        own = np.arange(n)
        resolved = pd.isna(t.next_id).to_numpy()
        inside = np.where(resolved, -1, pd.Index(ids).get_indexer(nxt_id))
        stop = inside < 0  # resolved rows and rows that leave
        nxt = np.where(stop, own, inside)
        rank = pd.Series(t.low.to_numpy(object)).rank(method="dense").to_numpy().astype(np.int64)
        low = rank.copy()
        steps, hops = np.where(stop, 0, t.steps.to_numpy(np.int64)), np.where(stop, 0, 1)
        for _ in range(max(1, int(n).bit_length())):
            steps, hops = steps + steps[nxt], hops + hops[nxt]
            low = np.minimum(low, low[nxt])
            nxt = nxt[nxt]
        looped = ~stop[nxt]
        if looped.any():  # names each loop: the least low over the loop, the same for all that run into it
            on = np.unique(nxt[looped])  # after 2^k >= n steps every pointer lies on a loop
            loop_low = dict(zip(on, low[on], strict=True))
            better = np.array([loop_low.get(i, 0) for i in nxt])
        by_rank = dict(zip(rank, t.low, strict=True))
        none = lambda c: np.where(pd.isna(c), None, c.to_numpy(object))
        root, depth, loop = none(t.root_id), t.depth.to_numpy(np.float64), none(t.loop_id)
        seg = t.seg.to_numpy(object)
        out_seg = np.empty(n, object)
        if with_paths:
            for i in np.argsort(hops, kind="stable"):  # what lies nearer to the exit first
                if not looped[i] and loop[nxt[i]] is None:
                    out_seg[i] = seg[i].tolist() if stop[i] else out_seg[inside[i]] + seg[i].tolist()
        end = nxt
        leaves = ~looped & ~resolved[end]
        yield pd.DataFrame({
            "node_id": ids,
            "next_id": np.where(leaves, nxt_id[end], None),
            "steps": np.where(leaves, steps + t.steps.to_numpy(np.int64)[end], 0),
            "low": [by_rank[r] for r in low],
            "root_id": [("cycle" if a else None if b else r) for a, b, r in zip(looped, leaves, root[end], strict=True)],
            "depth": [(-1 if a or loop[e] is not None else 0 if b else int(d + s)) for a, b, d, s, e in zip(looped, leaves, depth[end], steps, end, strict=True)],
            "loop_id": [(by_rank[better[i]] if looped[i] else None if leaves[i] else loop[end[i]]) for i in range(n)],
            "seg": out_seg,
        })

    return run


def _solve(links: DataFrame, rows: int, scratch: Scratch, with_paths: bool, most: int, last: int, level: int) -> DataFrame:
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-rows // most)) if level == 0 or rows > last else 1
    if level == 0:
        placed = links.repartitionByRange(parts, "node_id")
    elif parts == 1:
        placed = links.repartition(1)
    else:
        # A chain shrinks wherever a child lies beside its parent. Of each parent one child may move to it, by the
        # toss of a coin, so that no fragment grows above twice its share, however many children a parent has.
        coin = lambda c: F.xxhash64(F.col(c), F.lit(level)) % 2 == 0
        chosen = links.where(F.col("next_id").isNotNull()).groupBy("next_id").agg(F.min("node_id").alias("node_id"))
        chosen = chosen.where(~coin("node_id") & coin("next_id")).select("node_id", F.col("next_id").alias("beside"))
        placed = links.join(chosen, "node_id", "left").repartition(parts, F.coalesce("beside", "node_id")).drop("beside")
    done = scratch.keep(placed.select(*_LINKS.names).mapInPandas(_contract(with_paths), _LINKS), f"fragments{level}")
    open_rows = done.where(F.col("next_id").isNotNull())
    exits = open_rows.select(F.col("next_id").alias("node_id")).distinct()
    quotient = scratch.keep(done.join(exits, "node_id", "left_semi"), f"quotient{level}")
    count = quotient.count()
    if count == 0:
        return done
    solved = _solve(quotient, count, scratch, with_paths, most, last, level + 1)
    up = solved.select(F.col("node_id").alias("next_id"), F.col("root_id").alias("r"), F.col("depth").alias("d"),
                       F.col("loop_id").alias("l"), F.col("seg").alias("s"))
    grown = open_rows.join(up, "next_id").select(
        "node_id", F.lit(None).cast("string").alias("next_id"), F.lit(0).cast("long").alias("steps"), "low",
        F.col("r").alias("root_id"), F.when(F.col("l").isNotNull(), F.lit(-1)).otherwise(F.col("d") + F.col("steps")).cast("long").alias("depth"),
        F.col("l").alias("loop_id"), F.when(F.col("l").isNull(), F.concat("s", "seg")).alias("seg") if with_paths else F.lit(None).cast("array<string>").alias("seg"),
    )
    out = scratch.keep(done.where(F.col("next_id").isNull()).unionByName(grown), f"solved{level}")
    for name in (f"fragments{level}", f"quotient{level}", f"solved{level + 1}"):
        scratch.drop(name)
    return out


def hierarchy(nodes: DataFrame, with_paths: bool = True, fragment_rows: int = FRAGMENT_ROWS, quotient_rows: int = QUOTIENT_ROWS) -> DataFrame:
    """For each node: ``root_id``, ``depth``, ``path`` (root first, the node last) and ``loop_id``.

    A node on a loop, or below one, has root ``cycle``, depth -1, no path, and in ``loop_id`` the least id of the
    loop. ``dangling`` says that the node's own parent does not exist. Of a loop in several fragments the least id
    is taken over the loop's nodes as well. ``path`` is null without ``with_paths``; its total size is the sum of
    all depths, so ask for it only where trees are not chains of millions.
    """
    scratch = Scratch(nodes.sparkSession, "hierarchy")
    own = nodes.where(F.col("node_id").isNotNull()).groupBy(F.col("node_id").cast("string").alias("node_id"))
    own = scratch.keep(own.agg(F.max(F.col("parent_id").cast("string")).alias("parent_id")), "nodes")
    rows = own.count()
    there = own.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("found"))
    known = own.join(there, "parent_id", "left")
    up = F.when(F.col("found"), F.col("parent_id"))
    links = known.select(
        "node_id", up.alias("next_id"), F.lit(1).cast("long").alias("steps"), F.col("node_id").alias("low"),
        F.when(up.isNull(), F.col("node_id")).alias("root_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("string").alias("loop_id"), F.array("node_id").alias("seg"),
    )
    solved = _solve(links, rows, scratch, with_paths, fragment_rows, quotient_rows, 0)
    flags = known.select("node_id", "parent_id", (F.col("parent_id").isNotNull() & F.col("found").isNull()).alias("dangling"))
    return solved.join(flags, "node_id").select("node_id", "parent_id", "root_id", "depth", "loop_id", "dangling", F.col("seg").alias("path"))


def descendants(solved: DataFrame) -> DataFrame:
    """A row for each node and each node below it: ``node_id``, ``descendant_id``, ``distance`` (1 for children).

    It explodes the paths of ``hierarchy``, so no subtree is ever gathered, however large.
    """
    below = solved.select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "node_id"))
    return below.where(F.col("at") < F.col("depth")).select("node_id", "descendant_id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))
