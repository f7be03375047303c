"""Word sets of texts, their minhash keys, and pairs of alike sets.

The words of a text are its maximal runs of letters and digits in lower case; in Chinese runs each pair of
adjacent characters is a word instead (a single character gives none). A text is here a sorted array of 64-bit
word hashes; texts with equal arrays form a class, and all later work is on classes.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIKE = 0.6
#: Tables of at most so many classes are paired out; larger ones are split.
BUCKET = 128
#: Rows of one band that a task holds; more are sent on by their table keys.
WIDE = 4096
_CHUNK = 1 << 15

_HAN = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_HAN}]+|[^\W_{_HAN}]+")


@functools.lru_cache(maxsize=1 << 17)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def word_set(text: str | None) -> np.ndarray:
    out = set()
    for w in _WORD.findall((text or "").lower()):
        if "㐀" <= w[0] and re.match(f"[{_HAN}]", w):
            out.update(_hash(w[i : i + 2]) for i in range(len(w) - 1))
        else:
            out.add(_hash(w))
    return np.sort(np.fromiter(out, np.int64, len(out)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def word_hashes(text: pd.Series) -> pd.Series:
    return pd.Series([word_set(t) for t in text])


def class_id(words: Column) -> Column:
    return F.xxhash64(words)


@functools.cache
def _multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _lowest(words: np.ndarray, count: int, seed: int, part: slice = slice(None)) -> np.ndarray:
    """``count`` minhashes of a word set, of 32 bits each, or a part of them."""
    a, b = (x[part] for x in _multipliers(count, seed))
    count = len(a)
    w = (words >> 32).astype(np.uint32)[:, None]
    if len(w) <= 4096:
        return (w * a + b).min(0, initial=2**32 - 1)
    low = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(w), 4096):  # a very long text in pieces
        low = np.minimum(low, (w[at : at + 4096] * a + b).min(0))
    return low


def bands(sets: list[np.ndarray], count: int, rows: int, seed: int, part: range | None = None) -> np.ndarray:
    """For each word set ``count`` keys, or a part of them, each of ``rows`` minhashes."""
    part = range(count) if part is None else part
    own = slice(part.start * rows, part.stop * rows)
    low = np.stack([_lowest(w, count * rows, seed, own) for w in sets]).reshape(len(sets), len(part), rows).astype(np.uint64)
    key = np.zeros((len(sets), len(part)), np.uint64)
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
    return key


def banded(count: int, rows: int, seed: int = 1):
    """A column function: the ``count`` band keys of the first collection, and 16 bits of each band of the second one."""
    place = np.arange(count, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    @F.pandas_udf("keys array<long>, other binary")
    def run(words: pd.Series) -> pd.DataFrame:
        if not len(words):
            return pd.DataFrame({"keys": [], "other": []})
        sets = words.tolist()
        one = _mix(bands(sets, count, rows, seed) + place).view(np.int64)
        two = (bands(sets, count, rows, seed + 1) >> np.uint64(48)).astype(np.uint16)
        return pd.DataFrame({"keys": list(one), "other": [x.tobytes() for x in two]})

    return run


def band_keys(count: int, rows: int, part: range | None = None, seed: int = 1):
    """A column function: the band keys of the first collection alone, or those of a part of the bands."""
    part = range(count) if part is None else part
    place = np.arange(part.start, part.stop, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(list(_mix(bands(words.tolist(), count, rows, seed, part) + place).view(np.int64)) if len(words) else [])

    return run


def band_sketch(count: int, rows: int, seed: int = 1):
    """A column function: 16 bits of each band of the second collection."""

    @F.pandas_udf(T.BinaryType())
    def run(words: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in (bands(words.tolist(), count, rows, seed + 1) >> np.uint64(48)).astype(np.uint16)] if len(words) else [])

    return run


def tensored(sets: DataFrame, count: int, rows: int) -> DataFrame:
    """(key, id, other) of sets (id, words): a row for each band of the first collection, with all bands of the second.

    ``count`` bands of ``rows`` minhashes in two collections, combined pair by pair, stand for count * count tables:
    2 * count * rows minhashes take the place of 2 * count * count * rows, and a pair of similarity s meets with probability
    (1 - (1 - s**rows) ** count) ** 2. The table keys are formed where equal first bands meet.
    """
    return sets.where(F.size("words") > 0).select("id", banded(count, rows)("words").alias("b")).select(F.explode("b.keys").alias("key"), "id", F.col("b.other").alias("other"))


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["a", "b", "old", "kind"])


def _fill(n: int, kind: int) -> np.ndarray:
    return np.full(n, kind, np.int32)


def _sides(i, j, id_, old):
    """Pairs of rows as (a, b, old): b is the row of the history, if one of them is; else a < b. Two such rows are no pair."""
    keep = ~(old[i] & old[j]) & ((id_[i] != id_[j]) | (old[i] != old[j]))
    i, j = i[keep], j[keep]
    i, j = np.where(old[i], j, i), np.where(old[i], i, j)
    a, b, hist = id_[i], id_[j], old[j]
    return np.where(hist, a, np.minimum(a, b)), np.where(hist, b, np.maximum(a, b)), hist


def _combined(most: int, count: int, wide: int):
    """Rows (key, old, id, other) sorted by key, then old, to pairs (a, b, old) that share a table key: a key and one of the
    other bands. Two old rows (of a history) are no pair; ``old`` says that b is one.

    kind 0: a pair. kind 1: (table key, id, old) of a table with more than ``most`` rows. kind 2: the same of a band key
    with more than ``wide`` new rows, which are not held here; old rows beyond ``wide`` stream past the new ones.
    """

    def tables(key: np.ndarray, other: np.ndarray) -> np.ndarray:
        place = np.arange(count, dtype=np.uint64) << np.uint64(16)
        return _mix(_mix(key.view(np.uint64))[:, None] + (place | other.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def sketches(column: pa.Array) -> np.ndarray:
        """The rows of a binary column without nulls, all of one length, as they lie in its buffer."""
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(-1, count)

    def sharing(i: np.ndarray, j: np.ndarray, other: np.ndarray):
        """Of the pairs of rows those with an equal second band."""
        for at in range(0, len(i), _CHUNK):
            x, y = i[at : at + _CHUNK], j[at : at + _CHUNK]
            same = (other[x] == other[y]).view(np.uint64)
            hit = functools.reduce(np.bitwise_or, [same[:, c] for c in range(same.shape[1])]) != 0
            yield x[hit], y[hit]

    def paired(i, j, id_, other, old):
        live = ~(old[i] & old[j])
        for x, y in sharing(i[live], j[live], other):
            a, b, hist = _sides(x, y, id_, old)
            yield a, b, hist, _fill(len(a), 0)

    def large(s: slice, key, id_, other, old):
        """One band of many rows: its tables by sorting."""
        n = s.stop - s.start
        value = ((np.arange(count, dtype=np.int64) << 16) | other[s].astype(np.int64)).ravel()
        row = np.repeat(np.arange(s.start, s.stop), count)
        order = np.argsort(value, kind="stable")
        value, row = value[order], row[order]
        cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        seen = []
        for at, size in zip(cut[:-1], np.diff(cut), strict=True):
            own = row[at : at + size]
            if size < 2 or old[own].all():
                continue
            if size > most:
                spot = int(value[at]) >> 16
                name = tables(key[own[:1]], other[own[:1]])[0, spot]
                yield np.full(size, name), id_[own], old[own], _fill(size, 1)
            else:
                i, j = np.triu_indices(size, 1)
                seen.append((own[i] - s.start) * n + own[j] - s.start)
        if seen:
            both = np.unique(np.concatenate(seen))
            a, b, hist = _sides(both // n + s.start, both % n + s.start, id_, old)
            yield a, b, hist, _fill(len(a), 0)

    def close(key, old, id_, other):
        """All of some whole bands."""
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        start, size = cut[:-1], np.diff(cut)
        for n in np.unique(size[(size > 1) & (size <= BUCKET)]):
            i, j = np.triu_indices(n, 1)
            own = start[size == n][:, None]
            yield from paired((own + i).ravel(), (own + j).ravel(), id_, other, old)
        for at, n in zip(start[size > BUCKET], size[size > BUCKET], strict=True):
            yield from large(slice(at, at + n), key, id_, other, old)

    def resent(key, old, id_, other):
        yield tables(key, other).ravel(), np.repeat(id_, count), np.repeat(old, count), _fill(len(key) * count, 2)

    def past(new, key, old, id_, other):
        """Old rows of a band against its new rows."""
        n, m = len(new[2]), len(id_)
        step = max(1, (1 << 20) // max(1, n))
        ids, others, olds = np.concatenate([new[2], id_]), np.concatenate([new[3], other]), np.concatenate([new[1], old])
        for at in range(n, n + m, step):
            h = np.arange(at, min(n + m, at + step))
            yield from paired(np.tile(np.arange(n), len(h)), np.repeat(h, n), ids, others, olds)

    def run(batches):
        held, over, new = None, None, None  # over: a band that goes on and is too wide to hold; new: its new rows, if it streams
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            rows.append(sketches(batch.column(3)))
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            out = []
            if over is not None:
                end = int(np.searchsorted(rows[0], over, "right"))
                front, rows = [x[:end] for x in rows], [x[end:] for x in rows]
                if end:
                    out += past(new, *front) if new is not None else resent(*front)
                if len(rows[0]):
                    over = new = None
            if len(rows[0]):
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                out += close(*[x[:last] for x in rows])
                held = [x[last:] for x in rows]
                if len(held[0]) > wide:
                    over, fresh = held[0][0], ~held[1]
                    if fresh.all():
                        out += resent(*held)
                    else:
                        new = [x[fresh] for x in held]
                        out += close(*new) if fresh.any() else []
                        out += past(new, *[x[~fresh] for x in held])
                    held = None
            else:
                held = None
            if out:
                yield _batch(out)
        if held is not None and (out := list(close(*held))):
            yield _batch(out)

    return run


def meeting(keyed: DataFrame, scratch, count: int, most: int = BUCKET, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(pairs, large) of rows (key, old, id, other) by tensored banding.

    pairs: (a, b, old) that share a table, b being a row of the history where ``old``; else a < b. large: (bucket, id, old) of tables with
    more than ``most`` rows, at least one of them new. A class has many keys, so one key is a small part of all rows
    even where a third of the classes share it.
    """
    placed = keyed.select("key", "old", "id", "other").repartition("key").sortWithinPartitions("key", "old")
    met = placed.mapInArrow(_combined(most, count, wide), "a long, b long, old boolean, kind int")
    met = scratch.keep(met.distinct(), "combined")
    again = met.where("kind = 2").select(F.col("a").alias("key"), "old", F.col("b").alias("id"))
    again = scratch.keep(again.repartition("key").sortWithinPartitions("key", "old", "id").mapInArrow(_pairs(most), "a long, b long, old boolean, kind int").distinct(), "tables")
    all_ = met.unionByName(again)
    large = all_.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("id"), "old")
    return all_.where("kind = 0").select("a", "b", "old").distinct(), large


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all distinct words of two arrays without repeats; 0 where both are empty or one is null."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when((both > 0) & (shared >= 0), shared / both).otherwise(F.lit(0.0))


def _pairs(most: int):
    """Rows (key, old, id) sorted to pairs (a, b, old) that share a key, kind 0, or rows (key, id, old) of a key with more than ``most``
    rows, kind 1. At most ``most`` rows of the current key are held."""

    def close(key, old, id_):
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        start, size = cut[:-1], np.diff(cut)
        for n in np.unique(size[(size > 1) & (size <= most)]):
            i, j = np.triu_indices(n, 1)
            own = start[size == n][:, None]
            a, b, hist = _sides((own + i).ravel(), (own + j).ravel(), id_, old)
            yield a, b, hist, _fill(len(a), 0)
        many = np.repeat(size > most, size)
        yield key[many], id_[many], old[many], _fill(int(many.sum()), 1)

    def run(batches):
        held, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            out = []
            if hot is not None:
                end = int(np.searchsorted(rows[0], hot, "right"))
                out.append((rows[0][:end], rows[2][:end], rows[1][:end], _fill(end, 1)))
                rows = [x[end:] for x in rows]
            held = None
            if len(rows[0]):
                hot, last = None, int(np.searchsorted(rows[0], rows[0][-1]))
                if len(rows[0]) - last > most:
                    hot, last = rows[0][-1], len(rows[0])
                out += close(*[x[:last] for x in rows])
                held = [x[last:] for x in rows] if last < len(rows[0]) else None
            if out:
                yield _batch(out)
        if held is not None and (out := list(close(*held))):
            yield _batch(out)

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with their similarity where it is at least the threshold; sets: (id, words)."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    return two.select("a", "b", jaccard("wa", "wb").alias("similarity")).where(F.col("similarity") >= threshold)


def prefixes(members: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id, w) of members (bucket, id, words): the words of which alike members of a bucket share one.

    Sets alike to t share one of the first n - ceil(t * n) + 1 of their n words in any fixed order. The order is that of the
    bucket itself, rarest word first, so what all members have in common comes last and meets nothing.
    """
    word = members.select("bucket", "id", F.explode("words").alias("w"))
    often = word.groupBy("bucket", "w").agg(F.count("*").alias("n"))
    own = word.join(often, ["bucket", "w"]).groupBy("bucket", "id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"))
    head = F.size("o") - F.ceil(F.size("o") * F.lit(threshold) - 1e-9).cast("int") + 1
    return own.select("bucket", "id", F.explode(F.slice("o", F.lit(1), head)).alias("x")).where("x.n > 1").select("bucket", "id", F.col("x.w").alias("w"))


def alike_in_large(large: DataFrame, sets: DataFrame, scratch, threshold: float) -> DataFrame:
    """(a, b, old): the pairs in large buckets (bucket, id, old) that share a prefix word; sets: (id, words)."""
    members = scratch.keep(large.join(sets, "id"), "large-members")
    sub = prefixes(members.select("bucket", "id", "words").distinct(), threshold).join(members.select("bucket", "id", "old"), ["bucket", "id"])
    sub = scratch.keep(sub.select(F.xxhash64("bucket", "w").alias("key"), "id", "old").distinct(), "large-prefixes")
    side = lambda p: [F.col("id").alias(p), F.col("old").alias(f"old_{p}")]
    pairs = sub.where(~F.col("old")).select("key", *side("a")).join(sub.select("key", *side("b")), "key")
    return pairs.where(F.col("old_b") | (F.col("a") < F.col("b"))).select("a", "b", F.col("old_b").alias("old")).distinct()


def split_large(large: DataFrame, sets: DataFrame, scratch, threshold: float, rounds: int = 6, pivots: int = 16) -> DataFrame | None:
    """Links (a, b, similarity) inside large buckets (bucket, id) that join everything which alike pairs there join.

    Each round takes pivots in every bucket and the distance (1 - similarity, a metric) of all members to them. A
    member within reach of a pivot belongs to the nearest one and is linked to it, which joins a pivot's members
    without comparing them to each other. Any other member x can be alike to a member y of a pivot only if
    d(x, pivot) - d(y, pivot) is within reach and the two share a prefix word, so only those are compared. Members near no
    pivot go on to the next round; what is left after the last one is compared where prefix words are shared.
    """
    if large.isEmpty():
        return None
    reach, found = 1 - threshold + 1e-9, []
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    live = scratch.keep(large.select("bucket", "id").distinct().join(sets, "id"), "large0")
    word = scratch.keep(prefixes(live, threshold), "prefixes")
    for step in range(rounds):
        draw = F.struct(F.xxhash64("bucket", "id", F.lit(step)).alias("h"), "id", "words")
        drawn = live.groupBy("bucket", F.pmod(F.xxhash64("id", F.lit(step)), F.lit(pivots)).alias("s")).agg(F.min(draw).alias("p"))
        drawn = scratch.keep(drawn.select("bucket", F.col("p.id").alias("pivot"), F.col("p.words").alias("pw")), f"pivots{step}")
        far = live.join(drawn, "bucket").select("bucket", "id", "pivot", (1 - jaccard("words", "pw")).alias("d"))
        far = scratch.keep(far, f"far{step}")
        home = far.groupBy("bucket", "id").agg(F.min(F.struct("d", "pivot")).alias("m")).select("bucket", "id", F.col("m.d").alias("least"), F.col("m.pivot").alias("home"))
        home = scratch.keep(home, f"home{step}")
        in_ball = home.where(F.col("least") <= reach)
        found.append(in_ball.where("id <> home").select(*pair("id", "home"), (1 - F.col("least")).alias("similarity")))
        near = in_ball.where("least > 0").select("bucket", F.col("home").alias("pivot"), F.col("id").alias("y"), F.col("least").alias("dy")).join(word.withColumnRenamed("id", "y"), ["bucket", "y"])
        outer = far.where((F.col("d") > reach) & (F.col("d") <= 2 * reach)).withColumnRenamed("id", "x").join(word.withColumnRenamed("id", "x"), ["bucket", "x"])
        edge = outer.join(near, ["bucket", "pivot", "w"]).where(F.col("d") - F.col("dy") <= reach).select(*pair("x", "y")).where("a < b").distinct()
        found.append(scratch.keep(verified(edge, sets, threshold), f"edge{step}"))
        # The pivots' balls may touch as well: at most ``pivots`` of a bucket meet here.
        ends = drawn.select("bucket", "pivot").withColumnRenamed("pivot", "x").join(drawn.select("bucket", F.col("pivot").alias("y")), "bucket").where("x < y")
        found.append(verified(ends.select(*pair("x", "y")).distinct(), sets, threshold))
        live = scratch.keep(live.join(home.where(F.col("least") > reach).select("bucket", "id"), ["bucket", "id"]).select("id", "bucket", "words"), f"large{step + 1}")
        if live.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
    rest = alike_in_large(live.select("bucket", "id", F.lit(False).alias("old")), sets, scratch.part("rest"), threshold)
    return functools.reduce(DataFrame.unionByName, [*found, verified(rest.select("a", "b"), sets, threshold)])
