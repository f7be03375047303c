"""Exact set-similarity join by prefix filtering, and word-level top-k search for many queries at once."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import token_set, tokens
from sessionloom.operators.components import HELD, _contracted, components
from sessionloom.runtime import Scratch

#: Classes in a chunk of a block; two chunks meet in one task.
CHUNK = 1 << 14

#: Steps round the circle of a block's chunks that one round takes in either direction; a class goes to 2 * STEPS tasks at most.
STEPS = 2


def query_tokens(query: str) -> list[str]:
    """Runs of letters, digits and underscores of a query, in order, in their case."""
    return re.findall(r"\w+", query)


def _classes(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(membership, classes) of records (id, block, text): (id, block, class_id) and (block, key, class_id, set)."""
    r = records.where(F.col("id").isNotNull() & F.col("block").isNotNull()).select("id", "block", F.coalesce("text", F.lit("")).alias("text"))
    r = r.groupBy("id", "block").agg(F.max("text").alias("text")).select("id", "block", F.array_sort(token_set("text")).alias("set"), "text")
    key = F.when(F.size("set") > 0, F.concat(F.lit("t"), F.array_join("set", "\x1f"))).otherwise(F.concat(F.lit("r"), F.trim("text")))
    r = scratch.keep(r.select("id", "block", "set", key.alias("key")), "sets")
    classes = scratch.keep(r.groupBy("block", "key").agg(F.min("id").alias("class_id"), F.first("set").alias("set")), "classes")
    membership = r.join(classes.select("block", "key", "class_id"), ["block", "key"]).select("id", "block", "class_id")
    return membership, classes


def similar_classes(records: DataFrame, threshold: float, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, links) of records (id, block, text) by token-set Jaccard similarity inside blocks.

    Records of one block with equal token sets (for texts without tokens: equal trimmed texts) are one class; a copy
    held by a third of all rows is one row from here on. membership: (id, block, class_id), class_id being the least
    id of the class. links: (block, a, b, similarity), a < b, between classes alike to at least the threshold. Two
    sets alike to t share one of the first n - ceil(t * n) + 1 of their n tokens in any common order; with the rarest
    first, frequent tokens meet nothing; postings are joined by bands of sizes, and position bounds drop most of what still meets. Null texts are
    empty; rows without id or block are left out, repeated ids in a block count once; empty input gives no rows.
    """
    scratch = scratch or Scratch(records.sparkSession, "prefix-join")
    membership, classes = _classes(records, scratch)
    exploded = classes.select("block", "class_id", F.explode("set").alias("token"))
    often = exploded.groupBy("token").agg(F.count("*").alias("n"))
    placed = exploded.join(often, "token").groupBy("block", "class_id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    size = F.size("o")
    placed = placed.withColumn("size", size).withColumn("head", size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int") + 1)
    post = placed.select("block", "class_id", "size", F.posexplode(F.slice("o", F.lit(1), F.col("head"))).alias("pos", "t")).select("block", "class_id", "size", "pos", F.col("t.token").alias("token"))
    post = scratch.keep(post, "postings")
    # The smaller of two alike sets has at least t times the words of the other, so with bands of sizes in that ratio the
    # other is in the same band or the next: a frequent word's postings meet only where the sizes agree.
    band = F.floor(F.log(F.col("size")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.col("size")
    a = post.select("block", "token", *[F.col(c).alias(f"{c}_a") for c in ("class_id", "size", "pos")], F.explode(F.array(band, band + 1)).alias("band"))
    b = post.select("block", "token", *[F.col(c).alias(f"{c}_b") for c in ("class_id", "size", "pos")], band.alias("band"))
    need = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    met = a.join(b, ["block", "token", "band"]).where((F.col("size_a") < F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("class_id_a") < F.col("class_id_b")))
    met = met.where((F.col("size_a") >= F.col("size_b") * (threshold - 1e-9)) & (F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= need - F.least("pos_a", "pos_b")))
    pairs = met.select("block", F.least("class_id_a", "class_id_b").alias("a"), F.greatest("class_id_a", "class_id_b").alias("b")).distinct()
    sets = classes.select("block", F.col("class_id"), "set")
    full = pairs.join(sets.select("block", F.col("class_id").alias("a"), F.col("set").alias("sa")), ["block", "a"]).join(sets.select("block", F.col("class_id").alias("b"), F.col("set").alias("sb")), ["block", "b"])
    shared = F.size(F.array_intersect("sa", "sb"))
    links = full.select("block", "a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    return membership, links


def _joined(threshold: float, held: int = HELD):
    """The rows (node, chunk, lo, hi, words) of a pair of chunks to a forest (a, b) that joins what its alike pairs join.

    For each row of one chunk the words that it shares with each row of the other are counted from the postings, so that no
    pair is written anywhere. Of the alike pairs only those of parts that are not joined yet are held, and at most ``held`` and
    those of one row.
    """

    def run(group: pa.Table) -> pa.Table:
        node, chunk, lo, hi = (group.column(c).to_numpy() for c in ("node", "chunk", "lo", "hi"))
        words = group.column("words").combine_chunks()
        size = np.diff(words.offsets.to_numpy())
        _, word = np.unique(words.flatten().to_numpy(), return_inverse=True)
        own = np.repeat(np.arange(len(node)), size)
        left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        spot = np.full(len(node), -1)
        spot[right] = np.arange(len(right))
        met = spot[own] >= 0
        order = np.argsort(word[met], kind="stable")
        post, ends = spot[own[met]][order], np.concatenate([[0], np.cumsum(np.bincount(word[met], minlength=int(word.max(initial=-1)) + 1))])
        start = np.concatenate([[0], np.cumsum(size)])
        part, forest, fresh, rows, last = np.arange(len(node)), [], [], 0, None
        for i in left[np.argsort(size[left], kind="stable")]:
            if size[i] != last:
                last = size[i]
                # Never more than it takes; the division below decides.
                need = np.maximum(1, np.ceil((last + size[right]) * (threshold / (1 + threshold)) - 1e-6)).astype(np.int64)
            shared = np.bincount(np.concatenate([post[ends[w] : ends[w + 1]] for w in word[start[i] : start[i + 1]]]), minlength=len(right))
            j = np.flatnonzero(shared >= need)
            j = j[shared[j] / (last + size[right[j]] - shared[j]) >= threshold]
            j = right[j]
            j = j[part[j] != part[i]]
            if len(j):
                fresh.append((np.full(len(j), i), j))
                rows += len(j)
            if rows > held:
                forest = [_contracted(*(np.concatenate(x) for x in zip(*forest, *fresh, strict=True)))]
                part[forest[0][0]] = forest[0][1]
                fresh, rows = [], 0
        if forest or fresh:
            forest = [_contracted(*(np.concatenate(x) for x in zip(*forest, *fresh, strict=True)))]
        a, b = forest[0] if forest else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"a": node[a], "b": node[b]})

    return run


def joined_classes(records: DataFrame, threshold: float, scratch: Scratch | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(membership, edges): the classes of ``similar_classes``, and edges (a, b) that join exactly what its links join.

    Ends of edges are xxhash64(block, class_id). The classes of a block are cut into chunks of about ``chunk``, and a task has
    two chunks. Links may be as many as the square of a block; a task returns a forest, at most one edge for each of its classes.
    The chunks of a block stand in a circle and meet in rounds, the near ones first, so that a round sends each class to few
    tasks however many chunks there are; its shuffle is deleted and its edges become one forest before the next one.
    """
    scratch = scratch or Scratch(records.sparkSession, "joined")
    membership, classes = _classes(records, scratch)
    membership = scratch.keep(membership, "membership")
    scratch.drop("sets")
    full = classes.where(F.size("set") > 0)
    many = scratch.keep(full.groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "chunks")
    t = full.join(many, "block").select("block", F.xxhash64("block", "class_id").alias("node"), F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int").alias("chunk"), "chunks", F.transform("set", lambda w: F.xxhash64(w)).alias("words"))
    t = scratch.keep(t, "words")
    scratch.drop("classes")
    most, edges = many.agg(F.max("chunks")).first()[0] or 1, None
    for first in range(0, most // 2 + 1, STEPS):
        last = F.least(F.lit(first + STEPS - 1), F.floor(F.col("chunks") / 2).cast("int"))
        # Two chunks that are as far apart as half the circle meet by both ways round, but once.
        others = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(first), last), lambda d: F.array(F.pmod(F.col("chunk") + d, "chunks"), F.pmod(F.col("chunk") - d, "chunks")))))
        met = t.where(F.floor(F.col("chunks") / 2) >= first).select("block", "node", "chunk", "words", F.explode(others).alias("other"))
        met = met.select("block", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", "chunk", "words")
        fresh = scratch.keep(met.groupBy("block", "lo", "hi").applyInArrow(_joined(threshold), "a long, b long"), f"edges/joined{first}")
        if edges is None:
            edges = fresh
            continue
        roots = components(edges.union(fresh), scratch.part(f"edges/roots{first}")).where("node <> root")
        edges = scratch.keep(roots.toDF("a", "b"), f"edges/forest{first}")
        for over in (f"joined{first}", f"roots{first}", f"joined{first - STEPS}", f"forest{first - STEPS}"):
            scratch.drop(f"edges/{over}")
    scratch.drop("words")
    return membership, edges


def nearest(queries: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank) of the k best records for each query by word-level BM25.

    queries: (query_id, text); records: (id, text). Words meet through one equi-join on the word; scores are summed
    with map-side combine and cut to k before the last shuffle. Words of more than a tenth of all records carry next
    to no weight but are not dropped. Null texts are empty; a query whose words stand nowhere has no rows.
    """
    doc = records.where(F.col("id").isNotNull()).select("id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("word"))
    tf = doc.groupBy("id", "word").agg(F.count("*").alias("f"))
    length = tf.groupBy("id").agg(F.sum("f").alias("d"))
    total = length.agg(F.count("*").alias("n"), F.avg("d").alias("avg"))
    df = tf.groupBy("word").agg(F.count("*").alias("n_w"))
    q = queries.where(F.col("query_id").isNotNull()).select("query_id", F.explode(token_set(F.coalesce("text", F.lit("")))).alias("word"))
    met = q.join(df, "word").join(tf, "word").join(length, "id").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n") - F.col("n_w") + 0.5) / (F.col("n_w") + 0.5))
    part = idf * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("d") / F.col("avg")))
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
