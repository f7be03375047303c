"""Deduplicating new batches against all history (problem 1).

Incremental record linkage over tables that are kept between batches, each cut into folders by ranges of a hash:

``keys``      blocking keys of every accepted record: minhash bands
``records``   the accepted records' word sets with a sketch of further bands (see ``textsim``), by the hash of the set
``clusters``  rows (id, rep, step), by the hash of the id; the latest step of an id holds, and a rep may point on to another

A batch computes its own keys and opens only the folders that they fall into, then only those folders of records and
clusters in which something was met, and writes only its own rows and those of clusters that it joins. A folder has a
bounded number of rows, so a small batch reads about as much from a long history as from a short one.

Fields are scored with weights that an expectation-maximisation over the agreement patterns of the met pairs learns
(how much likelier a level of agreement is among true repeats than among chance meetings), without labels. The
score orders a candidate's possible originals; whether it is a repeat is settled by the exact word-set test.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.textsim import ALIKE, alike_in_large, band_keys, band_sketch, class_id, jaccard, meeting, word_hashes
from sessionloom.operators.components import components
from sessionloom.runtime import BROADCAST_ROWS, Scratch, in_force, shuffles_deleted, table

#: Bands and minhashes of a band in each of the two collections: a pair alike to 0.6 meets with probability 0.9974, to
#: 0.65 with 0.9998, to 0.7 with 0.99999; a pair alike to 0.2 with 0.005, to 0.15 with 0.0006.
BANDS, ROWS = 48, 4
#: Rows in a folder of a kept table.
FOLDER_ROWS = 400_000
#: Keys of batch and history that cross the network with their sketches at once, until ``PASSES`` share all bands.
PASS_KEYS, PASSES = 1_000_000, 16
#: Met pairs that cross the network with their word sets at once, until ``PASSES`` share all.
PASS_PAIRS = 150_000
_LEVELS = (0.3, 0.6, 0.85)


def _prepared(df: DataFrame) -> DataFrame:
    """id, pos, title, words, cid from (id, pos, title, lesson); of repeated ids the first position holds."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = df.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("pos", blank("title").alias("title"), blank("lesson").alias("lesson"))).alias("f"))
    t = first.select("id", "f.pos", word_hashes("f.title").alias("title"), word_hashes("f.lesson").alias("lesson"))
    # No word reaches over the blank between title and lesson.
    t = t.select("id", "pos", "title", F.array_sort(F.array_union("title", "lesson")).alias("words"))
    return t.withColumn("cid", class_id(F.col("words")))


def _level(c: str) -> Column:
    return sum((F.col(c) >= x).cast("int") for x in _LEVELS)


def learn_weights(patterns: list[tuple[int, int, int]], rounds: int = 60) -> np.ndarray:
    """log(m / u) for each of two fields and four levels from (level of field 1, level of field 2, pairs)."""
    lv, n = np.array([p[:2] for p in patterns], int).reshape(-1, 2), np.array([p[2] for p in patterns], float)
    m, u, share = np.tile([0.05, 0.1, 0.25, 0.6], (2, 1)), np.tile([0.6, 0.25, 0.1, 0.05], (2, 1)), 0.5
    for _ in range(rounds if len(n) else 0):
        pm, pu = share * m[0, lv[:, 0]] * m[1, lv[:, 1]], (1 - share) * u[0, lv[:, 0]] * u[1, lv[:, 1]]
        g = pm / (pm + pu)
        share = float(np.clip((g * n).sum() / n.sum(), 0.01, 0.99))
        for f in range(2):
            m[f] = np.bincount(lv[:, f], g * n, 4) + 0.5
            u[f] = np.bincount(lv[:, f], (1 - g) * n, 4) + 0.5
            m[f], u[f] = m[f] / m[f].sum(), u[f] / u[f].sum()
    return np.log(m / u)


def first_come(classes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, original): the classes that repeat an earlier one which is itself no repeat, with the earliest such.

    classes: (cid, pos); edges (a, b). In each round a class with no undecided earlier neighbour is accepted, and the
    later neighbours of accepted ones are repeats; a round decides at least the first of every chain, so there are as
    many rounds as the longest chain of alternating decisions. A round writes one table.
    """
    at = classes.select(F.col("cid").alias("a"), F.col("pos").alias("pa"))
    bt = classes.select(F.col("cid").alias("b"), F.col("pos").alias("pb"))
    e = edges.join(at, "a").join(bt, "b")
    earlier = F.col("pa") < F.col("pb")
    every = e.select(F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("later"), F.least("pa", "pb").alias("p"))
    every = scratch.keep(every, "order")
    live, decided, step = every, [], 0
    while True:
        waits = live.select(F.col("later").alias("first")).distinct().withColumn("waits", F.lit(True))
        live = scratch.keep(live.join(waits, "first", "left").withColumn("accepted", F.col("waits").isNull()).drop("waits"), f"round{step}")
        if live.isEmpty():
            break
        decided.append(live.where("accepted").select(F.col("later").alias("cid")))
        repeat = decided[-1].distinct()
        live = live.where(~F.col("accepted")).drop("accepted")
        live = live.join(repeat.withColumnRenamed("cid", "later"), "later", "left_anti").join(repeat.withColumnRenamed("cid", "first"), "first", "left_anti").select("first", "later", "p")
        step += 1
    if not decided:
        return edges.select(F.col("a").alias("cid"), F.col("b").alias("original")).limit(0)
    repeats = functools.reduce(DataFrame.union, decided).distinct()
    # The original is the earliest neighbour that is itself no repeat, in whichever round it was accepted.
    own = every.join(repeats.select(F.col("cid").alias("later")), "later", "left_semi").join(repeats.select(F.col("cid").alias("first")), "first", "left_anti")
    return scratch.keep(own.groupBy(F.col("later").alias("cid")).agg(F.min(F.struct("p", "first")).alias("m")).select("cid", F.col("m.first").alias("original")), "repeats")


def _keyed(sets: DataFrame, part: range | None = None) -> DataFrame:
    """A row for each band key, or for those of a part of the bands, from (words, other columns)."""
    rest = [c for c in sets.columns if c != "words"]
    return sets.select(*rest, F.explode(band_keys(BANDS, ROWS, part)("words")).alias("key"))


def _words(prepared: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cid, pos, title, words, other) of the word sets of (id, pos, title, words, cid), each once; of the first position the title."""
    one = prepared.groupBy("cid").agg(F.min(F.struct("pos", "title")).alias("f"), F.first("words").alias("words"))
    return scratch.keep(one.select("cid", "f.pos", "f.title", "words", band_sketch(BANDS, ROWS)("words").alias("other")), name)


def _in_parts(pairs: int, work, scratch: Scratch, name: str) -> DataFrame:
    """The kept results of ``work(own)`` for parts of so many pairs; ``own(c)`` says that a row is of the part by its column c."""
    parts = min(PASSES, max(1, -(-pairs // PASS_PAIRS)))
    done = [scratch.keep(work(lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(parts)) == k), f"{name}{k}") for k in range(parts)]
    return functools.reduce(DataFrame.union, done)


_KEPT = {
    "keys": ("key", "key long, id long"),
    "records": ("cid", "cid long, kind int, pos long, id string, title array<long>, words array<long>, other binary"),
    "clusters": ("id", "id string, rep string, step int"),
}


class Linker:
    """The kept tables of one collection and the work of a batch on them.

    ``history_rows``: about how many records there will be; it decides the number of folders of each table.
    """

    def __init__(self, spark: SparkSession, path: str, history_rows: int, threshold: float = ALIKE, folder_rows: int = FOLDER_ROWS):
        self.spark, self.path, self.threshold, self.step = spark, path, threshold, 0
        self.folders = {name: max(1, -(-history_rows * (BANDS if name == "keys" else 1) // folder_rows)) for name in _KEPT}

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(_KEPT[name][0]), 9), F.lit(self.folders[name])).cast("int")

    def _write(self, df: DataFrame, name: str) -> None:
        by, schema = _KEPT[name]
        t = df.select(*[c.split()[0] for c in schema.split(", ")]).withColumn("bucket", self._bucket(name))
        # Keys are all different, so a dictionary of them only costs time.
        with shuffles_deleted(self.spark):
            t.repartition("bucket").sortWithinPartitions("bucket", by).write.mode("append").option("parquet.enable.dictionary", name != "keys").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def kept(self, name: str, wanted: DataFrame | None = None, rows: int = 0) -> DataFrame:
        """A kept table; with ``wanted`` (rows with its key column) only the folders in which those can lie.

        So many more ``rows`` than folders fall into every folder, and are not looked at.
        """
        t = self.spark.read.schema(_KEPT[name][1] + ", bucket int").parquet(f"{self.path}/{name}")
        if wanted is not None and 1 < self.folders[name] and rows < 30 * self.folders[name]:
            numbers = [r.bucket for r in wanted.select(self._bucket(name).alias("bucket")).distinct().collect()]  # folder numbers
            if len(numbers) < self.folders[name]:
                t = t.where(F.col("bucket").isin(numbers))
        return t.drop("bucket")

    def _accept(self, records: DataFrame, words: DataFrame, kind: int, scratch: Scratch, spent: str) -> None:
        """Adds records (id, pos, cid), of which history has no equal word set; words: (cid, title, words, other), in the table ``spent``."""
        self.step += 1
        one = records.groupBy("cid").agg(F.min(F.struct("pos", "id")).alias("r")).select("cid", F.lit(kind).alias("kind"), "r.*")
        one = scratch.keep(one.join(words, "cid"), "accepted")
        scratch.drop(spent)
        self._write(one, "records")
        self._write(_keyed(one.where(F.size("words") > 0).select(F.col("cid").alias("id"), "words")), "keys")
        self._write(records.select("id", F.col("id").alias("rep"), F.lit(self.step).alias("step")), "clusters")
        scratch.drop("accepted")

    def bootstrap(self, records: DataFrame) -> None:
        """Takes (id, title, lesson) as history without testing it; the least id stands for equal word sets."""
        scratch = Scratch(self.spark, "bootstrap")
        full = scratch.keep(_prepared(records.select("id", F.lit(0).cast("long").alias("pos"), "title", "lesson")), "history")
        # The title that stands for equal word sets is that of the least id.
        words = _words(full.withColumn("pos", F.struct("pos", "id")), scratch, "words").drop("pos")
        full = scratch.keep(full.select("id", "pos", "cid"), "ids")
        scratch.drop("history")
        self._accept(full, words, 0, scratch, "words")
        scratch.drop("ids")

    def _meetings(self, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """What ``meeting`` finds between sets (cid, words, other) and history: (pairs, large), and the records that were read for it.

        Few sets take the kept keys of their folders and then the sketches of the records which those name. Many would open
        all folders; they make the keys of history anew from its word sets, a part of the bands at a time, so that
        sketches and keys of one part only lie on disk. A table belongs to one band, so the parts find the same as all at once.
        """
        rows = sets.count() * BANDS
        mine = sets.select(F.col("cid").alias("id"), "words", "other")
        if rows <= BROADCAST_ROWS:  # counted: so many keys of 8 bytes
            keyed = scratch.keep(_keyed(mine), "keys")
            old = self.kept("keys", keyed, rows).join(F.broadcast(keyed.select("key").distinct()), "key", "left_semi")
            old = scratch.keep(old, "old-keys")
            wanted = scratch.keep(old.select(F.col("id").alias("cid")).union(sets.select("cid")).distinct(), "named")
            read = scratch.keep(self.kept("records", wanted).join(wanted, "cid", "left_semi"), "read")
            old = old.join(read.select(F.col("cid").alias("id"), "other"), "id")
            found = [meeting(keyed.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True))), scratch, BANDS)]
        else:
            history, found, read = self.kept("records").where(F.size("words") > 0), [], None
            every = mine.withColumn("old", F.lit(False)).unionByName(history.select(F.col("cid").alias("id"), "words", "other", F.lit(True).alias("old")))
            parts = min(PASSES, max(1, -(-every.count() * BANDS // PASS_KEYS)))
            for k in range(parts):
                inner = scratch.part(f"bands{k}")
                pairs, large = meeting(_keyed(every, range(k * BANDS // parts, (k + 1) * BANDS // parts)), inner, BANDS)
                found.append((inner.keep(pairs, "pairs"), inner.keep(large, "large")))
                inner.drop("combined")
                inner.drop("tables")
        met, large = (functools.reduce(DataFrame.union, x) for x in zip(*found, strict=True))
        return scratch.keep(met.distinct(), "met"), scratch.keep(large, "large"), read

    def link(self, batch: DataFrame) -> DataFrame:
        """Finds the repeats in (id, pos, title, lesson) and accepts the rest: (id, original_id, score, history).

        ``history`` says that the original was there before the batch. A batch may hold several queued batches;
        ``pos`` orders all rows (ties go by id). Null fields are empty; a record without words is never a repeat.
        An empty batch changes nothing.
        """
        scratch = Scratch(self.spark, "link")
        # A position of its own for each record: ties in pos go by id.
        full = scratch.keep(_prepared(batch).withColumn("pos", F.struct("pos", "id")), "batch")
        every = _words(full, scratch, "classes")
        b = scratch.keep(full.select("id", "pos", "cid", (F.size("words") > 0).alias("worded")), "ids")
        scratch.drop("batch")
        sets = every.where(F.size("words") > 0)
        met, large, read = self._meetings(sets, scratch)
        # Word sets are read of what was met, and of equal sets.
        wanted = met.where("old").select(F.col("b").alias("cid")).union(large.where("old").select("id")).union(sets.select("cid")).distinct()
        wanted = scratch.keep(wanted, "wanted")
        history = scratch.keep((self.kept("records", wanted) if read is None else read).join(wanted, "cid", "left_semi").drop("other"), "history")
        if not large.isEmpty():
            words = sets.select(F.col("cid").alias("id"), "words").union(history.select("cid", "words")).dropDuplicates(["id"])
            met = scratch.keep(met.union(alike_in_large(large, words, scratch, self.threshold)).distinct(), "met-all")
        equal = sets.join(history.select("cid"), "cid", "left_semi").select(F.col("cid").alias("c"), F.col("cid").alias("h"))
        across = met.where("old").select(F.col("a").alias("c"), F.col("b").alias("h")).union(equal).distinct()
        across = scratch.keep(across, "across")
        side = lambda p, k: [F.col("cid").alias(k), F.col("title").alias(f"{p}t"), F.col("words").alias(f"{p}w")]

        def measured(own) -> DataFrame:
            known = history.where(own("cid")).select(*side("h", "h"), F.col("id").alias("h_id"), "kind", F.col("pos").alias("h_pos"))
            t = across.where(own("h")).join(known, "h").join(sets.select(*side("c", "c")), "c")
            return t.select("c", "h", "h_id", "kind", "h_pos", jaccard("ht", "ct").alias("t"), jaccard("hw", "cw").alias("w"))

        pairs = _in_parts(across.count(), measured, scratch, "pairs")
        scratch.drop("history")
        counted = pairs.groupBy(_level("t").alias("a"), _level("w").alias("b")).count().collect()  # at most 16 patterns
        weight = learn_weights([(r.a, r["b"], r["count"]) for r in counted])
        value = lambda f, c: sum((F.when(_level(c) == k, float(weight[f, k])).otherwise(0.0) for k in range(4)), F.lit(0.0))
        alike = scratch.keep(pairs.where(F.col("w") >= self.threshold).withColumn("score", value(0, "t") + value(1, "w")), "alike")
        # A memory comes before an accepted candidate; of memories the best score, the most shared words, the least id.
        rank = F.struct("kind", F.when(F.col("kind") == 1, F.col("h_pos")).alias("at"), (-F.col("score")).alias("s"), (-F.col("w")).alias("w"), F.col("h_id").alias("id"))
        old = alike.groupBy(F.col("c").alias("cid")).agg(F.min(rank).alias("m")).select("cid", F.col("m.id").alias("original_id"), (-F.col("m.s")).alias("score"))
        old = scratch.keep(old, "old")
        new = sets.join(old, "cid", "left_anti")
        within = met.where(~F.col("old")).select("a", "b")
        word = lambda t, k: t.select(F.col("cid").alias(k), F.col("words").alias(f"w{k}"))
        alike_new = lambda own: within.where(own("a")).join(word(new.where(own("cid")), "a"), "a").join(word(new, "b"), "b").where(jaccard("wa", "wb") >= self.threshold).select("a", "b")
        inner = first_come(new.select("cid", "pos"), _in_parts(within.count(), alike_new, scratch, "within"), scratch)
        lead = b.where("worded").groupBy("cid").agg(F.min("pos").alias("lead"))
        origin = inner.join(lead.select(F.col("cid").alias("original"), F.col("lead.id").alias("original_id")), "original").select("cid", "original_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("history"))
        known = old.withColumn("history", F.lit(True)).unionByName(origin)
        t = b.join(lead, "cid", "left").join(known, "cid", "left")
        repeat = F.coalesce("original_id", F.when(F.col("pos") > F.col("lead"), F.col("lead.id")))
        result = scratch.keep(t.select("id", "pos", "cid", repeat.alias("original_id"), "score", F.coalesce("history", F.lit(False)).alias("history")), "result")
        self._accept(result.where(F.col("original_id").isNull()).select("id", F.col("pos.pos").alias("pos"), "cid"), every.drop("pos"), 1, scratch, "classes")
        self._join_clusters(result, alike, scratch)
        return result.where(F.col("original_id").isNotNull()).select("id", "original_id", "score", "history")

    def clusters(self) -> DataFrame:
        """(id, rep) of all records."""
        return self._find(None, Scratch(self.spark, "clusters"))

    def _find(self, records: DataFrame | None, scratch: Scratch) -> DataFrame:
        """(id, rep) of the given records (column id), or of all: pointers are followed until they stand still."""

        def latest(ids: DataFrame | None) -> DataFrame:
            t = self.kept("clusters", ids)
            return (t if ids is None else t.join(ids, "id", "left_semi")).groupBy("id").agg(F.max_by("rep", "step").alias("rep"))

        at, step = latest(records), 0
        while True:
            at = scratch.keep(at, f"find{step}")
            ends = at.select(F.col("rep").alias("id")).distinct()
            up = latest(ends).select(F.col("id").alias("rep"), F.col("rep").alias("top")).where("rep <> top")
            up = scratch.keep(up, f"up{step}")
            if up.isEmpty():
                return at
            at, step = at.join(up, "rep", "left").select("id", F.coalesce("top", "rep").alias("rep")), step + 1

    def _join_clusters(self, result: DataFrame, alike: DataFrame, scratch: Scratch) -> None:
        """Union-find over representatives: a repeat that is alike to records of several clusters joins them.

        Only representatives that this batch links are looked up and rewritten.
        """
        links = result.where(F.col("original_id").isNotNull()).select("id", "original_id", "cid")
        touched = alike.select(F.col("c").alias("cid"), F.col("h_id").alias("record"))
        pairs = links.select("cid", F.col("original_id").alias("record")).union(touched).distinct()
        now = self._find(scratch.keep(pairs.select(F.col("record").alias("id")).distinct(), "touched"), scratch).withColumnRenamed("id", "record")
        both = pairs.join(now, "record").select("cid", "rep").distinct()
        low = both.groupBy("cid").agg(F.min("rep").alias("low"))
        edge = both.join(low, "cid").select("low", "rep").where("low <> rep").distinct()
        edge = scratch.keep(edge.select(F.xxhash64("low").alias("a"), F.xxhash64("rep").alias("b"), "low", "rep"), "merges")
        self.step += 1
        names = edge.select(F.col("a").alias("node"), F.col("low").alias("name")).union(edge.select("b", "rep")).distinct()
        roots = components(edge.select("a", "b"), scratch).join(names, "node")
        least = roots.groupBy("root").agg(F.min("name").alias("top"))
        moved = scratch.keep(roots.join(least, "root").where("name <> top").select(F.col("name").alias("id"), F.col("top").alias("rep")), "moved")
        first = links.select("id", F.col("original_id").alias("record")).join(now, "record").select("id", "rep")
        first = first.join(moved.select(F.col("id").alias("rep"), F.col("rep").alias("top")), "rep", "left").select("id", F.coalesce("top", "rep").alias("rep"))
        self._write(moved.union(first).withColumn("step", F.lit(self.step)), "clusters")


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_force(table(spark, sf_dir, "memories"), "id", "updated_at", ["id", "updated_at", "title", "lesson"]).select("id", "title", "lesson")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One order over all batches: rows of a batch are numbered from 0 and far fewer than 2^32.
    pos = F.shiftleft(F.col("batch_no"), 32) + F.col("pos")
    return table(spark, sf_dir, "candidates").select("id", F.coalesce(pos, F.lit(2**62)).alias("pos"), "batch_no", "title", "lesson")


def _linker(spark: SparkSession, sf_dir: str) -> Linker:
    linker = Linker(spark, Scratch(spark, "linkage").path, table(spark, sf_dir, "memories").count())
    linker.bootstrap(_memories(spark, sf_dir))
    return linker


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queued batches against the memories, in one run of ``link``."""
    found = _linker(spark, sf_dir).link(_candidates(spark, sf_dir).drop("batch_no"))
    return found.select(F.col("id").alias("candidate_id"), "original_id")


def p1_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest batch against memories and all earlier batches, which were linked before it."""
    linker, c = _linker(spark, sf_dir), _candidates(spark, sf_dir)
    last = c.agg(F.max("batch_no").alias("n")).collect()[0].n
    last = -1 if last is None else last
    linker.link(c.where(F.col("batch_no") < last).drop("batch_no"))
    newest = c.where(F.col("batch_no") == last).join(c.where(F.col("batch_no") < last).select("id"), "id", "left_anti")
    return linker.link(newest.drop("batch_no")).select(F.col("id").alias("candidate_id"), "original_id", "history")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of every memory and candidate after all batches."""
    linker = _linker(spark, sf_dir)
    linker.link(_candidates(spark, sf_dir).drop("batch_no"))
    return linker.clusters()


QUERIES = {"p1_found": p1_found, "p1_last_batch": p1_last_batch, "p1_clusters": p1_clusters}
ORACLE: dict[str, str] = {}
