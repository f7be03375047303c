import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm.near_duplicates import near_duplicates
from sessionloom.llm.textsim import split_large, word_hashes, word_set
from sessionloom.runtime import Scratch


def alike(a, b, t=0.6):
    both = len(np.union1d(a, b))
    return both > 0 and len(np.intersect1d(a, b)) >= t * both


def brute(texts, t=0.6):
    sets = {i: word_set(x) for i, x in texts.items()}
    group = {i: i for i in texts}
    for a, b in combinations(texts, 2):
        if alike(sets[a], sets[b], t):
            x, y = group[a], group[b]
            group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    return group


def edited(rng, words, vocabulary, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


def corpus(seed, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = {}
    for b in range(40):
        words = rng.sample(vocabulary, 60)
        for c in range(copies if b == 0 else rng.choice([1, 2, 4])):
            texts[f"d{b:02d}-{c:03d}"] = edited(rng, words, vocabulary, rng.choice([0, 0.03, 0.08]))
    return texts


@pytest.mark.parametrize(("copies", "bucket", "wide"), [(5, 48, 4096), (60, 8, 4096), (200, 48, 4096), (60, 48, 10), (60, 8, 10), (60, 2, 10), (60, 10**6, 10**6)])
def test_groups_equal_brute_force_with_small_and_large_buckets(spark, copies, bucket, wide):
    texts = corpus(copies, copies)
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "id string, text string"), bucket=bucket, wide=wide).collect()
    assert {r.id: r.group_id for r in rows} == brute(texts)


def test_words():
    assert len(word_set("Foo_bar foo BAR 12,5")) == 4
    assert len(word_set("同步队列ab同")) == 4  # three pairs, ab; a single character has no pair
    assert len(word_set(None)) == len(word_set(" .,")) == 0


def test_nulls_empty_long_and_clashing_columns(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [("a", None, 1), ("b", "", 2), ("c", "one two three", 3), ("c", "one two three", 4), ("d", "three TWO, one!", 5), (None, "x", 6), ("e", long, 7), ("f", long + " extra", 8)]
    got = {r.id: (r.group_id, r.size) for r in near_duplicates(spark.createDataFrame(rows, "id string, text string, key int")).collect()}
    assert got == {"a": ("a", 1), "b": ("b", 1), "c": ("c", 2), "d": ("c", 2), "e": ("e", 2), "f": ("e", 2)}
    empty = spark.createDataFrame([], "id string, text string")
    assert near_duplicates(empty).count() == 0
    assert empty.select(word_hashes("text")).count() == 0


def test_pairs_at_the_threshold_are_not_missed(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(20000)]
    texts = {}
    for n in range(400):  # 60 of 100 words in common
        w = rng.sample(words, 100)
        texts[f"{n}-a"], texts[f"{n}-b"] = " ".join(w[:80]), " ".join(w[:60] + w[80:])
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "id string, text string")).collect()
    assert sum(r.size == 1 for r in rows) / 2 <= 5


def test_half_of_all_rows_in_one_table_and_not_alike(spark):
    """Large buckets of sets that share many words, but fewer than the threshold asks for, and a few alike pairs among them."""
    rng = random.Random(9)
    base = list(range(40))
    sets = {n: sorted({*base, *(1000 + rng.randrange(10**6) for _ in range(50))}) for n in range(600)}
    for n in range(600, 640):
        sets[n] = sorted({*sets[n - 600][:-3], 7_000_000 + n})
    frame = spark.createDataFrame(list(sets.items()), "id long, words array<long>")
    links = split_large(frame.select(F.lit(5).cast("long").alias("bucket"), "id"), frame, Scratch(spark, "test"), 0.6, rounds=2)
    assert {(r.a, r.b) for r in links.select("a", "b").collect()} == {(n - 600, n) for n in range(600, 640)}
