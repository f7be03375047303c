"""Running totals, ranks and neighbours over keys of any size.

A window partitioned by a key puts all its rows into one task. Here the rows are range-partitioned by key and
order, so a large key spreads over many tasks; each task works on its own stretch, and what the stretches before
it hold of the same key is added. A stretch continues at most one key of the stretch before, so those additions
are at most one row for each partition and can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.runtime import Scratch

_AT = "__stretch"


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, str], partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Adds for each entry ``new: column`` the total of the column over the rows of the same keys before this row.

    The column ``1`` counts rows, so ``{"rank": "1"}`` numbers each key's rows from 0. Null values count as 0, a
    null key is a key of its own; rows that are equal in keys and order get their places in no fixed order, so end
    ``order`` with an id. Empty input gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession, "runs")
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "stretches-" + "-".join(totals)
    placed = df.repartitionByRange(parts, *keys, *order).withColumn(_AT, F.spark_partition_id())
    placed = scratch.keep(placed, name)
    value = lambda c: F.lit(1).cast("long") if c == "1" else F.coalesce(F.col(c), F.lit(0))
    same = [F.coalesce(F.struct(*[F.col(k) for k in keys]).cast("string"), F.lit("")).alias("__key")]
    stretch = placed.select(_AT, *same, *[value(c).alias(f"__t{i}") for i, c in enumerate(totals.values())])
    sums = stretch.groupBy(_AT, "__key").agg(*[F.sum(f"__t{i}").alias(f"__t{i}") for i in range(len(totals))])
    # Only a key at the start of a stretch can continue; the others have no earlier stretch.
    wider = Window.partitionBy("__key").orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(_AT).over(Window.partitionBy("__key"))
    before = sums.select(_AT, "__key", first.alias("__first"), *[F.sum(f"__t{i}").over(wider).alias(f"__b{i}") for i in range(len(totals))])
    before = before.where(F.col(_AT) > F.col("__first")).drop("__first")
    within = Window.partitionBy(_AT, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"__o{i}": F.coalesce(F.sum(value(c)).over(within), F.lit(0)) for i, c in enumerate(totals.values())})
    own = own.withColumn("__key", same[0]).join(F.broadcast(before), [_AT, "__key"], "left")
    return own.select(*df.columns, *[(F.col(f"__o{i}") + F.coalesce(F.col(f"__b{i}"), F.lit(0))).alias(new) for i, new in enumerate(totals)])
