"""Near-duplicate records with small edits (problem 3).

Tensored banding: two small collections of minhash bands are combined pair by pair into table keys. Classes of equal
word sets that meet in a table are compared exactly, and the alike pairs are joined to groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.textsim import ALIKE, BUCKET, WIDE, class_id, meeting, split_large, tensored, verified, word_hashes
from sessionloom.operators.components import components
from sessionloom.runtime import Scratch, in_force, table

#: Bands of each collection and minhashes of a band: a pair alike to 0.6 meets with probability 0.9974, to 0.65 with
#: 0.9998, to 0.7 with 0.99999; a pair alike to 0.2 with 0.005, to 0.15 with 0.0006.
BANDS, ROWS = 48, 4


def near_duplicates(records: DataFrame, threshold: float = ALIKE, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET, wide: int = WIDE) -> DataFrame:
    """For records (id, text): ``id``, ``class_id`` (the least id of equal word sets), ``class_size``, ``group_id`` (the
    least id of the group that alike steps join), ``size`` (of the group).

    A null text is an empty one; a text without words is alike to none and is its own class and group. Rows without id are
    left out; of several rows of one id the one with the greatest text counts. Empty input gives an empty result.
    """
    scratch = Scratch(records.sparkSession, "near-duplicates")
    own = records.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    members = scratch.keep(own.select("id", word_hashes("text").alias("words")).withColumn("class", class_id(F.col("words"))), "members")
    sets = members.where(F.size("words") > 0).groupBy(F.col("class").alias("id")).agg(F.first("words").alias("words"))
    sets = scratch.keep(sets, "sets")
    pairs, large = meeting(tensored(sets, bands, rows).withColumn("old", F.lit(False)), scratch, bands, bucket, wide)
    links = scratch.keep(verified(pairs.select("a", "b"), sets, threshold), "verified")
    if not large.isEmpty():
        # A class of a large group stands in very many large tables. One of them is worked on first; tables whose
        # classes are all in one group by then have nothing left to join.
        first = split_large(large.groupBy("id").agg(F.min("bucket").alias("bucket")), sets, scratch.part("first"), threshold)
        links = scratch.keep(links.unionByName(first), "joined")
        root = components(links.select("a", "b"), scratch.part("roots")).withColumnRenamed("node", "id")
        rooted = large.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        more = split_large(large.join(mixed, "bucket", "left_semi"), sets, scratch.part("rest"), threshold)
        links = links if more is None else links.unionByName(more)
    joined = components(links.select("a", "b"), scratch)
    t = members.join(joined.select(F.col("node").alias("class"), "root"), "class", "left")
    lone = F.concat(F.lit("="), F.col("id"))
    some = F.size("words") > 0
    t = t.select("id", F.when(some, F.col("class").cast("string")).otherwise(lone).alias("c"), F.when(some, F.coalesce("root", "class").cast("string")).otherwise(lone).alias("k"))
    classes = scratch.keep(t.groupBy("c", "k").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    groups = classes.groupBy("k").agg(F.min("class_id").alias("group_id"), F.sum("class_size").alias("size"))
    return t.join(classes, ["c", "k"]).join(groups, "k").select("id", "class_id", "class_size", "group_id", "size")


def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = in_force(table(spark, sf_dir, "memories"), "id", "updated_at", ["id", "updated_at", "title", "trigger_text", "lesson"])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return m.select("id", F.concat_ws(" ", blank("title"), blank("trigger_text"), blank("lesson")).alias("text"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(memory_texts(spark, sf_dir)).select("id", "class_id", "class_size", "group_id", "size")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs inside each group, as the result is defined."""
    t = near_duplicates(memory_texts(spark, sf_dir)).where("size > 1").select("group_id", "id")
    return t.withColumnRenamed("id", "id_a").join(t.withColumnRenamed("id", "id_b"), "group_id").where("id_a < id_b").select("id_a", "id_b")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE: dict[str, str] = {}
