"""Long exact spans shared between records (problem 8).

Recompression: a text starts as a sequence of tokens, and in each round runs of equal symbols and pairs of adjacent
symbols become one symbol with a name of its own. Which pairs join is decided by the two names alone, so equal stretches of
text get the same symbols inside, wherever they stand, and differ only near their ends. There are two ways to agree on names:

* ``named_in_rounds``: each round is a Spark job that gathers the distinct runs and pairs of all texts into one dictionary,
  numbers them, and joins the numbers back. All symbols cross the network twice a round.
* ``symbols``: a name is a fingerprint of the characters that a symbol stands for. Every task comes to the same
  names without a dictionary, so all rounds run where the text lies and only what is met crosses the network.

Both give equal stretches equal symbols (the tests compare their results). The registered queries use the second: the
first does not fit the budget (figures in the README).

The key of a place is the run of symbols that begins there, as far as they end within ``WINDOW`` characters; a stretch of the
required length that two texts share has such a run inside. Equal keys are met by one shuffle of (key, document,
place). Places of two documents with the same distance form chains where their runs touch; all spans are compared character by character in the
end, except inside the runs of a chain; only a chain's ends are looked up in the texts and extended to the whole common span. Where more than
``BUCKET`` places share a key, no pairs of them are formed: each place gives the fingerprints of all stretches of the required
length around it, and only places that share such a stretch, which is a result, are brought together.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.runtime import Scratch, small, table

LEAST = 200
#: A key has the symbols that end within so many characters, and more than ``WINDOW - CAP`` of them.
WINDOW = 80
#: No symbol stands for more characters than this.
CAP = 40
ROUNDS = 10
BUCKET = 64
CHUNK = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        p = np.full(n, base % 2**64, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


def symbols(codes: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS, cap: int = CAP) -> tuple[np.ndarray, object]:
    """(first characters of the symbols of the last round, fingerprint function) of texts laid end to end.

    ``codes``: code points; ``starts``: where each text begins. No symbol reaches over the end of a text.
    """
    n = len(codes)
    size = 1 << max(10, int(n).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix((codes.astype(np.uint64) + _U(1)) * _U(0xA24BAED4963EE407)) * power[:n], out=total[1:])

    def fingerprint(a, b):
        return _mix((total[b] - total[a]) * inverse[a])

    at = _token_starts(codes, starts, cap)
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    for r in range(rounds):
        end = np.append(at[1:], n)
        name = fingerprint(at, end)
        inner = ~begins[at[1:]]  # the symbol after belongs to the same text
        same = (name[1:] == name[:-1]) & inner
        drop = np.zeros(len(at), bool)
        if same.any():
            run_start = np.flatnonzero(~np.concatenate([[False], same]))
            run_end = np.append(run_start[1:], len(at))
            span = np.append(at, n)[run_end] - at[run_start]
            short = np.repeat((span <= cap) & (run_end - run_start > 1), run_end - run_start)
            drop[1:] = same & short[1:]
            alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        else:
            alone = None
        toss = (_mix(name + _U((r * 0x9E3779B97F4A7C15 + 1) % 2**64)) >> _U(40)) & _U(1)
        join = (toss[:-1] == 0) & (toss[1:] == 1) & inner & (end[1:] - at[:-1] <= cap)
        if alone is not None:
            join &= alone[:-1] & alone[1:]
        drop[1:] |= join
        at = at[~drop]
    return at, fingerprint


def runs(at: np.ndarray, stop: np.ndarray, width: int, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first symbol, end) of the runs of whole symbols within ``width`` characters, without short ones.

    ``at``: first characters of symbols; ``stop``: the end of the text that each is in.
    """
    end = np.minimum(np.append(at[1:], stop[-1:]), stop)
    last = np.searchsorted(end, np.minimum(at + width, stop), "right") - 1
    reach = end[np.maximum(last, 0)]
    keep = np.flatnonzero(reach - at >= width - cap)
    return keep, reach[keep]


def _keys(width: int, least: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            todo, held = [], 0
            for i, t in enumerate([*texts, None]):
                if t is not None and len(t) >= least:
                    todo.append(i)
                    held += len(t)
                if todo and (i == len(texts) or held >= CHUNK):
                    codes = np.frombuffer("".join(texts[j] for j in todo).encode("utf-32-le"), np.uint32)
                    sizes = np.array([len(texts[j]) for j in todo])
                    stop = np.cumsum(sizes)
                    at, fingerprint = symbols(codes, stop - sizes)
                    doc = np.searchsorted(stop, at, "right")
                    keep, end = runs(at, stop[doc], width)
                    at, doc = at[keep], doc[keep]
                    key = fingerprint(at, end).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[todo][doc]), pa.array((at - (stop - sizes)[doc]).astype(np.int32)), pa.array((end - at).astype(np.int32))], ["key", "doc", "pos", "size"])
                    todo, held = [], 0

    return run


def _token_starts(codes: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """First characters of the tokens of texts laid end to end: runs of letters and digits, and single other characters."""
    n = len(codes)
    word = ((codes >= 48) & (codes <= 57)) | ((codes | 32) >= 97) & ((codes | 32) <= 122) | ((codes >= 0xC0) & (codes < 0x250))
    first = np.ones(n, bool)
    first[1:] = ~(word[1:] & word[:-1])
    first[starts] = True
    length = np.diff(np.flatnonzero(first), append=n)
    if (length > cap // 2).any():  # a very long token is taken as its characters
        first[np.flatnonzero(np.repeat(length > cap // 2, length))] = True
    return np.flatnonzero(first)


def _tokens(cap: int):
    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _token_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]), cap)
                end = np.append(at[1:], len(text))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array([text[a:b] for a, b in zip(at, end, strict=True)])], ["doc", "pos", "size", "token"])

    return run


def named_in_rounds(d: DataFrame, scratch: Scratch, rounds: int = ROUNDS, cap: int = CAP) -> DataFrame:
    """(doc, pos, size, name): the symbols of the last round of texts (doc_id, text), named by dictionaries of all texts."""
    token = scratch.keep(d.mapInArrow(_tokens(cap), "doc long, pos int, size int, token string"), "tokens")
    names = scratch.keep(token.select("token").distinct().withColumn("name", F.monotonically_increasing_id()), "names")
    row = scratch.keep(token.join(names, "token").select("doc", "pos", "size", "name"), "level0")
    line = Window.partitionBy("doc").orderBy("pos")
    for r in range(rounds):
        coin = lambda c, r=r: F.xxhash64(F.col(c), F.lit(r)) % 2 == 0
        t = row.withColumn("head", F.coalesce(F.lag("name").over(line) != F.col("name"), F.lit(True)))
        t = t.withColumn("run", F.sum(F.col("head").cast("int")).over(line))
        own = Window.partitionBy("doc", "run")
        t = t.withColumns({"n": F.count("*").over(own), "span": F.sum("size").over(own).cast("int")})
        t = t.withColumns({"alone": F.col("n") == 1, "next": F.lead("name").over(line), "next_size": F.lead("size").over(line)}).withColumn("next_alone", F.lead("alone").over(line))
        left = F.col("alone") & F.coalesce("next_alone", F.lit(False)) & coin("name") & ~coin("next") & (F.col("size") + F.col("next_size") <= cap)
        t = t.withColumn("left", F.coalesce(left, F.lit(False))).withColumn("right", F.coalesce(F.lag("left").over(line), F.lit(False)))
        merged = ~F.col("alone") & (F.col("span") <= cap)
        t = t.where(~F.col("right") & (~merged | F.col("head")))
        size = F.when(F.col("left"), F.col("size") + F.col("next_size")).when(merged, F.col("span")).otherwise(F.col("size"))
        t = scratch.keep(t.select("doc", "pos", size.alias("size"), "name", F.when(F.col("left"), F.col("next")).when(merged, -F.col("n")).alias("other")), f"joined{r}")
        names = t.where("other IS NOT NULL").select("name", "other").distinct()
        names = scratch.keep(names.withColumn("new", F.monotonically_increasing_id() + F.lit((r + 1) << 54)), f"names{r}")
        row = scratch.keep(t.join(names, ["name", "other"], "left").select("doc", "pos", "size", F.coalesce("new", "name").alias("name")), f"level{r + 1}")
    return row


def _named_keys(row: DataFrame, width: int, cap: int = CAP) -> DataFrame:
    """(key, doc, pos, size): the same runs by the names of their symbols."""
    near = Window.partitionBy("doc").orderBy("pos").rangeBetween(0, width - 1)
    t = row.withColumn("near", F.collect_list(F.struct("pos", "size", "name")).over(near))
    inside = F.filter("near", lambda x: x["pos"] + x["size"] <= F.col("pos") + width)
    size = (F.array_max(F.transform(inside, lambda x: x["pos"] + x["size"])) - F.col("pos")).cast("int")
    return t.select(F.xxhash64(F.transform(inside, lambda x: x["name"])).alias("key"), "doc", "pos", size.alias("size")).where(F.col("size") >= width - cap)


_MET = ["a", "pa", "b", "pb", "size", "hot"]


def _meet(most: int):
    """Sorted rows (key, doc, pos, size) to pairs of places (doc_a < doc_b), or to hot rows (a, pa, size) where a key has many places."""

    def pairs(doc: np.ndarray, pos: np.ndarray, size: np.ndarray):
        i, j = np.triu_indices(len(doc), 1)
        ok = doc[i] != doc[j]
        i, j = i[ok], j[ok]
        return doc[i], pos[i], doc[j], pos[j], size[i], np.zeros(len(i), bool)

    def run(batches):
        held, hot, last = None, False, None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            key = rows[0]
            if not len(key):
                continue
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            out = []
            for s in np.flatnonzero((np.diff(cut) > 1) | (cut[:-1] == 0) | (cut[1:] == len(key))):
                k, own = key[cut[s]], [x[cut[s] : cut[s + 1]] for x in rows[1:]]
                if last is None or k != last:
                    if held is not None and len(held[0]) > 1:
                        out.append(pairs(*held))
                    held, hot, last = None, False, k
                if not hot and held is not None:
                    own = [np.concatenate(x) for x in zip(held, own, strict=True)]
                if hot or len(own[0]) > most:
                    hot, held, n = True, None, len(own[0])
                    out.append((own[0], own[1], np.full(n, -1, np.int64), np.full(n, -1, np.int32), own[2], np.ones(n, bool)))
                else:
                    held = own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], _MET)
        if held is not None and len(held[0]) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(*held)], _MET)

    return run


def _common(backward: bool):
    """How many characters two texts share from the start, or from the end."""

    @F.pandas_udf("long")
    def run(one, two):
        def shared(a: str, b: str) -> int:
            if backward:
                a, b = a[::-1], b[::-1]
            n = min(len(a), len(b))
            if a[:n] == b[:n]:
                return n
            lo, hi = 0, n  # a[:lo] is shared, a[:hi] is not
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
            return lo

        return one.combine(two, shared).astype("int64")

    return run


def _chains(shift: DataFrame) -> DataFrame:
    """Equal stretches of ``size`` characters (a, b, pa, shift, size) to (n, a, b, shift, lo, hi) where they touch."""
    line = Window.partitionBy("a", "b", "shift").orderBy("pa", "size")
    before = F.max(F.col("pa") + F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    chained = shift.withColumn("new", F.coalesce((F.col("pa") > before).cast("int"), F.lit(1)))
    chained = chained.withColumn("chain", F.sum("new").over(line)).groupBy("a", "b", "shift", "chain").agg(F.min("pa").alias("lo"), F.max(F.col("pa") + F.col("size")).alias("hi"))
    return chained.select(F.monotonically_increasing_id().alias("n"), "a", "b", "shift", "lo", "hi")


def _grown(d: DataFrame, chains: DataFrame, count: int, reach: int) -> DataFrame:
    """The ``count`` chains with ``l`` and ``r``: by how many characters, ``reach`` at most, the texts are equal on either side."""
    ends = chains.select("n", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.lit(0).alias("side"), "lo", "hi"), F.struct(F.col("b").alias("doc_id"), F.lit(1).alias("side"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi")))).alias("e")).select("n", "e.*")
    cut = d.join(small(ends, 2 * count), "doc_id").select(
        "n", "side", F.substring("text", F.greatest(F.lit(1), F.col("lo") + 1 - reach), F.least(F.lit(reach), F.col("lo"))).alias("left"), F.substring("text", F.col("hi") + 1, F.lit(reach)).alias("right"),
    )
    sides = cut.groupBy("n").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("left", "right")])
    return chains.join(sides, "n").withColumns({"l": _common(True)("left0", "left1"), "r": _common(False)("right0", "right1")})


def _ends(lo: Column, hi: Column) -> list[Column]:
    return [F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), lo.alias("start_a"), (lo + F.col("shift")).alias("start_b"), (hi - lo).alias("length")]


def shared_spans(docs: DataFrame, least: int = LEAST, window: int = WINDOW, bucket: int = BUCKET, in_rounds: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans, hot) of docs (doc_id, text).

    spans: (doc_a < doc_b, start_a, start_b, length): common spans of at least ``least`` characters, in pairs of places that
    few others share. hot: (key, doc_id, start): stretches of exactly ``least`` characters that stand at many
    places; rows of one key are equal. Together they reveal every pair with a common stretch of that length, up to the chance that
    no run of symbols lies inside it equally (measured in the tests). Null and short
    texts share nothing; ids must be unique; an empty table gives no rows. ``in_rounds``: names by dictionaries.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    d = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select("doc_id", "text")
    keyed = _named_keys(named_in_rounds(d, scratch.part("names")), window) if in_rounds else d.mapInArrow(_keys(window, least), "key long, doc long, pos int, size int")
    met = keyed.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(_meet(bucket), "a long, pa int, b long, pb int, size int, hot boolean")
    met = scratch.keep(met, "met")
    shift = met.where(~F.col("hot")).select("a", "b", "pa", (F.col("pb") - F.col("pa")).alias("shift"), "size").distinct()
    chains = scratch.keep(_chains(shift), "chains")
    grown = _grown(d, chains, chains.count(), 2 * least)  # as far as another run would have been met
    spans = scratch.keep(grown.select(*_ends(F.col("lo") - F.col("l"), F.col("hi") + F.col("r"))).where(F.col("length") >= least).distinct(), "spans")

    places = met.where("hot").select(F.col("a").alias("doc_id"), F.col("pa").alias("pos"), "size").distinct()
    if places.isEmpty():
        return spans, docs.sparkSession.createDataFrame([], "key long, doc_id long, start int")
    first = F.greatest(F.lit(0), F.col("pos") + F.col("size") - least)  # stretches that hold the whole run
    last = F.least(F.col("pos"), F.length("text") - least)
    # Cut out the text around a place before its stretches are listed, so that no row carries a whole text.
    around = d.join(places, "doc_id").where(last >= first)
    around = around.select("doc_id", first.alias("first"), (last - first).alias("more"), F.substring("text", first + 1, last - first + least).alias("around"))
    stretch = around.select("doc_id", "first", "around", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("i"))
    hot = stretch.select(F.xxhash64(F.substring("around", F.col("i") + 1, F.lit(least))).alias("key"), "doc_id", (F.col("first") + F.col("i")).alias("start")).distinct()
    hot = scratch.keep(hot, "stretches")
    many = hot.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    return spans, scratch.keep(hot.join(many, "key", "left_semi"), "hot")


def whole_spans(docs: DataFrame, least: int = LEAST, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(doc_a < doc_b, start_a, start_b, length, many): whole common spans, none of them longer on either side.

    ``many`` is false for pairs of places that few others share; all of these are listed. A stretch of ``least``
    characters that stands at many places is listed against one of them only, the first place in the least document (places
    of that document itself against the greatest one): two places share what their spans have in common there.
    So the rows grow with the places, not with their pairs, and every place of a shared stretch lies in a row.
    """
    scratch = Scratch(docs.sparkSession, "whole-spans")
    d = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select("doc_id", "text")
    spans, hot = shared_spans(docs, least, window, bucket)
    reach = 2 * least
    cut = reach + window - CAP  # the least length of a chain, grown to one side as far as it is looked at
    whole = [spans.where(F.col("length") < cut).withColumn("many", F.lit(False))]
    # A span this long may have been cut where its text is hot.
    long = spans.where(F.col("length") >= cut).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), (F.col("start_b") - F.col("start_a")).alias("shift"), F.col("start_a").alias("lo"), (F.col("start_a") + F.col("length")).alias("hi"), F.lit(False).alias("many"))
    first = hot.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("x"), F.max(F.struct("doc_id", -F.col("start"))).alias("y"))
    met = hot.join(first, "key").where((F.col("doc_id") != F.col("x.doc_id")) | (F.col("start") != F.col("x.start")))
    own = F.col("doc_id") == F.col("x.doc_id")
    met = met.select(F.col("x.doc_id").alias("a"), F.when(own, F.col("y.doc_id")).otherwise(F.col("doc_id")).alias("b"), F.when(own, F.col("start")).otherwise(F.col("x.start")).alias("pa"), F.when(own, -F.col("y.col2")).otherwise(F.col("start")).alias("pb"))
    shift = met.select("a", "b", "pa", (F.col("pb") - F.col("pa")).alias("shift"), F.lit(least).alias("size")).distinct()
    open_ = long.unionByName(_chains(shift).drop("n").withColumn("many", F.lit(True)))
    step = 0
    while True:
        chains = scratch.keep(open_.select(F.monotonically_increasing_id().alias("n"), "a", "b", "shift", "lo", "hi", "many"), f"chains{step}")
        grown = _grown(d, chains, chains.count(), reach)
        grown = scratch.keep(grown.select("a", "b", "shift", (F.col("lo") - F.col("l")).alias("lo"), (F.col("hi") + F.col("r")).alias("hi"), "many", ((F.col("l") >= reach) | (F.col("r") >= reach)).alias("open")), f"grown{step}")
        whole.append(grown.where(~F.col("open")).select(*_ends(F.col("lo"), F.col("hi")), "many"))
        open_ = grown.where("open").drop("open").distinct()
        if open_.isEmpty():
            break
        step, reach = step + 1, 4 * reach
    out = functools.reduce(DataFrame.unionByName, whole)
    return out.groupBy("doc_a", "doc_b", "start_a", "start_b", "length").agg(F.max("many").alias("many"))


def covered(spans: DataFrame, hot: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, shared_chars): characters of each document that stand in another one too, in stretches of ``least``."""
    a = spans.select(F.col("doc_a").alias("doc_id"), F.col("start_a").cast("long").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
    b = spans.select(F.col("doc_b").alias("doc_id"), F.col("start_b").cast("long").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
    h = hot.select("doc_id", F.col("start").cast("long").alias("s"), (F.col("start") + least).alias("e"))
    all_ = a.unionByName(b).unionByName(h).groupBy("doc_id", "s").agg(F.max("e").alias("e"))
    before = Window.partitionBy("doc_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("e").over(before), F.lit(0))
    return all_.select("doc_id", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), seen)).alias("n")).groupBy("doc_id").agg(F.sum("n").cast("long").alias("shared_chars"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, hot = shared_spans(table(spark, sf_dir, "documents"))
    h = hot.select("key", "doc_id").distinct()
    more = h.withColumnRenamed("doc_id", "doc_a").join(h.withColumnRenamed("doc_id", "doc_b"), "key").where("doc_a < doc_b")
    return spans.select("doc_a", "doc_b").unionByName(more.select("doc_a", "doc_b")).distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole common spans; a stretch at many places is listed against one of them (see ``whole_spans``)."""
    return whole_spans(table(spark, sf_dir, "documents"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, how many of its characters stand in another one, and the share of its text."""
    docs = table(spark, sf_dir, "documents")
    n = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    t = n.join(covered(*shared_spans(docs)), "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return t.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_coverage": p8_coverage}
ORACLE: dict[str, str] = {}
