"""Filling fixed-capacity containers with items (problem 6).

Vector bin packing with the dot-product heuristic: a container has room for tokens, segments and loss-bearing
tokens; of the items that still fit in all three, the one whose size vector has the greatest dot product with the
room left is put in, until none fits. The dimensions weigh as much as the items yet to be packed need of them, so that
what is scarce is used up evenly. Room for segments and loss is what the collection needs on average and
``SLACK`` more, so that a container cannot hold only dialogue turns or only text that bears loss.

Items are dealt by a hash of their id to groups of bounded size, each packed by one task, so the work is spread evenly
however the sizes are distributed. The containers that a group leaves part empty are opened again and their items
dealt to fewer groups, until one group is left.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.tokens import TOKENIZER, sizes
from sessionloom.runtime import Scratch, table

#: Items that one task packs together.
GROUP_ITEMS = 4096
#: A container's room for segments and for loss-bearing tokens, over the mean of the items.
SLACK = (1.5, 1.1)
#: A container with less of its tokens used is opened again, if there are other groups.
FULL = 0.97
#: Container numbers of one level of packing; the levels have numbers of their own.
_LEVEL = 1 << 42

_OUT = "pack_name string, container_id long, doc_id long, piece long, start_token long, tokens long, segments long, loss_tokens long"


def fill(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The container's number for each item (rows: tokens, segments, loss); each item must fit an empty container."""
    out = np.full(len(items), -1, np.int64)
    order = np.argsort(-items[:, 0], kind="stable")
    size = np.ascontiguousarray((items[order] / room).T)  # a row for each dimension
    bin_ = 0
    while len(order):
        weight = size.sum(1)
        weight, left, taken = weight / weight.max(), np.ones(len(room)), []
        open_ = np.zeros(len(order))  # -inf once an item is taken
        while True:
            first = np.searchsorted(-size[0], -left[0] - 1e-12)  # sorted by tokens: smaller items stand after it
            if first >= len(order):
                break
            score = open_[first:] + size[0, first:] * (left[0] * weight[0])
            for k in range(1, len(room)):
                score += size[k, first:] * (left[k] * weight[k])
                score[size[k, first:] > left[k] + 1e-12] = -np.inf
            pick = first + int(np.argmax(score))
            if score[pick - first] == -np.inf:
                break
            open_[pick] = -np.inf
            taken.append(pick)
            left = left - size[:, pick]
        out[order[taken]] = bin_
        bin_ += 1
        order, size = np.delete(order, taken), np.delete(size, taken, 1)
    return out


def _rooms(packs: list[tuple[str, int]], density: tuple[float, float]) -> dict[str, np.ndarray]:
    """Of each container: tokens, segments, loss-bearing tokens that it takes."""
    return {name: np.array([capacity, max(1, np.ceil(capacity * density[0])), max(1, np.ceil(capacity * min(1.0, density[1])))], float) for name, capacity in packs}


def _pack_group(rooms: dict[str, np.ndarray], groups: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pack_name", "doc_id", "piece", "tokens"], kind="stable")
        group, out = int(pdf.g.iloc[0]), []
        for name, own in pdf.groupby("pack_name", sort=False):
            room = rooms[name]
            r = own[["tokens", "segments", "loss_tokens"]].to_numpy(float)
            alone = (r > room).any(1)
            bins = np.full(len(own), -1, np.int64)
            bins[~alone] = fill(r[~alone], room)
            bins[alone] = bins.max(initial=-1) + 1 + np.arange(alone.sum())
            used = np.bincount(bins, r[:, 0])
            done = ((used >= FULL * room[0]) | np.bincount(bins, alone).astype(bool))[bins]
            out.append(own.assign(container_id=level * _LEVEL + bins * groups + group, done=done))
        return pd.concat(out, ignore_index=True)[[*(c.split()[0] for c in _OUT.split(", ")), "done"]]

    return run


def pack(items: DataFrame, packs: list[tuple[str, int]], group_items: int = GROUP_ITEMS, slack: tuple[float, float] = SLACK, density: tuple[float, float] | None = None) -> DataFrame:
    """Assigns items (doc_id, tokens, segments, loss) to containers of each (name, capacity).

    Only an item of more tokens than the capacity is split, into pieces of exactly the capacity, each with a container of
    its own, and a rest; segments and loss are shared out in proportion. ``density``: room for segments and loss of one
    token of capacity; by default the mean over all items and ``slack``. An item that alone exceeds the room for segments
    or loss, but not the capacity, is not split and has a container of its own. Items without tokens or id are
    left out, repeated rows are packed each; no items give no rows. The order of rows does not matter: ties go by id.
    """
    scratch = Scratch(items.sparkSession, "packing")
    items = scratch.keep(items.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "tokens", "segments", "loss"), "items")
    n, tokens, segments, loss = items.agg(F.count("*"), F.sum("tokens"), F.sum(F.greatest("segments", F.lit(1))), F.sum("loss")).collect()[0]  # one row
    rooms = _rooms(packs, density or (slack[0] * (segments or 0) / (tokens or 1), slack[1] * (loss or 0) / (tokens or 1)))

    sized = items.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(capacity).cast("long").alias("capacity")) for name, capacity in packs])).alias("p")).select("*", "p.*")
    sized = sized.withColumn("whole", F.when(F.col("tokens") > F.col("capacity"), F.expr("tokens div capacity")).otherwise(F.lit(0).cast("long")))
    share = lambda c, t: F.when(F.col("tokens") == t, F.col(c)).otherwise(F.ceil(F.col(c) * t / F.col("tokens")))

    def piece(number: Column, size: Column) -> list[Column]:
        return ["pack_name", "doc_id", number.cast("long").alias("piece"), (number * F.col("capacity")).cast("long").alias("start_token"), size.cast("long").alias("tokens"),
                F.greatest(F.lit(1), share("segments", size)).cast("long").alias("segments"), F.least(size, share("loss", size)).cast("long").alias("loss_tokens")]

    full = sized.where("whole > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).select(*piece(F.col("k"), F.col("capacity")))
    full = full.withColumn("container_id", -1 - F.monotonically_increasing_id())  # as many containers as pieces
    rest = sized.where(F.col("tokens") > F.col("whole") * F.col("capacity")).select(*piece(F.col("whole"), F.col("tokens") - F.col("whole") * F.col("capacity")))
    columns = [c.split()[0] for c in _OUT.split(", ")]
    out, left, level = [full.select(*columns)], rest, 0
    while n:
        groups = max(1, -(-n // group_items))
        dealt = left.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(groups)))
        # The rows are few bytes and much work: a partition for each group, which adaptive execution leaves as it is.
        packed = scratch.keep(dealt.repartition(groups, "g").groupBy("g").applyInPandas(_pack_group(rooms, groups, level), _OUT + ", done boolean"), f"level{level}")
        again = packed.where(~F.col("done")).drop("container_id", "done")
        left_over = 0 if groups == 1 else max([r.n for r in again.groupBy("pack_name").agg(F.count("*").alias("n")).collect()], default=0)  # a row for each capacity
        if left_over == 0 or left_over > n // 2:  # nothing to mend, or limits other than the groups leave room empty
            out.append(packed.select(*columns))
            break
        out.append(packed.where("done").select(*columns))
        left, n, level = again, left_over, level + 1
    return functools.reduce(DataFrame.unionByName, out)


def _packs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return sorted((r.pack_name, int(r.capacity_tokens)) for r in table(spark, sf_dir, "pack_sizes").dropna().distinct().collect())  # a fixed table


def p6_pack(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", sizes(F.col("text"), tokenizer).alias("s")).select("doc_id", "s.*"), _packs(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: containers, tokens, the share of the room that is filled, the least room for segments and loss
    that would have done, and how many containers have at least 95 % of the most that any has of each of the three."""
    packed = p6_pack(spark, sf_dir)
    per = packed.where("container_id >= 0").groupBy("pack_name", "container_id").agg(F.count("*").alias("items"), *[F.sum(c).alias(c) for c in ("tokens", "segments", "loss_tokens")])
    most = per.where("items > 1").groupBy("pack_name").agg(*[F.max(c).alias(f"most_{c}") for c in ("segments", "loss_tokens")])
    per = per.join(F.broadcast(most), "pack_name").join(F.broadcast(table(spark, sf_dir, "pack_sizes")), "pack_name")  # a row for each capacity
    near = lambda x: F.sum((F.col(x[0]) >= 0.95 * F.col(x[1])).cast("long"))
    filled = per.groupBy("pack_name").agg(
        F.first("most_segments").alias("most_segments"), F.first("most_loss_tokens").alias("most_loss_tokens"),
        near(("tokens", "capacity_tokens")).alias("at_tokens"), near(("segments", "most_segments")).alias("at_segments"), near(("loss_tokens", "most_loss_tokens")).alias("at_loss"),
    )
    all_ = packed.groupBy("pack_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.sum((F.col("piece") > 0).cast("long")).alias("later_pieces"))
    all_ = all_.join(table(spark, sf_dir, "pack_sizes"), "pack_name").select("pack_name", "containers", "tokens", "later_pieces", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
    return all_.join(filled, "pack_name", "left")


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill}
ORACLE: dict[str, str] = {}
