import random
import time

import numpy as np

from sessionloom.llm import linkage
from sessionloom.llm.linkage import Linker, learn_weights
from sessionloom.llm.textsim import bands, meeting, word_set
from sessionloom.runtime import Scratch


def alike(a, b):
    both = len(np.union1d(a, b))
    return both > 0 and len(np.intersect1d(a, b)) >= 0.6 * both


def brute(memories, candidates):
    sets = {i: word_set(f"{t or ''} {x or ''}") for i, t, x in memories}
    kept, out, seen = {}, {}, set()
    for i, _, t, x in sorted(candidates, key=lambda c: (c[1], c[0])):
        if i in seen:
            continue
        seen.add(i)
        w = word_set(f"{t or ''} {x or ''}")
        old = {m for m, s in sets.items() if alike(s, w)}
        new = [c for c, s in kept.items() if alike(s, w)]
        if old:
            out[i] = old
        elif new:
            out[i] = {new[0]}
        else:
            kept[i] = w
    return out


def data(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(600)]

    def edit(text, n):
        t = text.split()
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(words)
        return " ".join(t)

    base = [" ".join(rng.sample(words, 50)) for _ in range(30)]
    memories = [(f"m{i:02d}", f"title {i}", edit(b, rng.choice([0, 3]))) for i, b in enumerate(base[:15])]
    candidates = []
    for n in range(90):
        b = rng.randrange(30)
        candidates.append((f"c{n:03d}", n, f"title {b}", edit(base[b], rng.choice([0, 2, 5, 20]))))
    chain = " ".join(rng.sample(words, 50))
    for n in range(100, 112):  # each text alike to the one before, ever further from the first
        chain = edit(chain, 6)
        candidates.append((f"c{n:03d}", n, "chain", chain))
    candidates += [("c005", 200, "title", "repeated row"), ("d1", 201, None, None), ("d2", 202, "", ""), ("d3", 203, "title 3", memories[3][2])]
    return memories, candidates


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, pos long, title string, lesson string")


def start(spark, memories):
    linker = Linker(spark, Scratch(spark, "test").path, len(memories))
    linker.bootstrap(spark.createDataFrame(memories, "id string, title string, lesson string"))
    return linker


def test_one_run_and_batch_by_batch_equal_brute_force(spark):
    memories, candidates = data(4)
    want = brute(memories, candidates)
    got = {r.id: r.original_id for r in start(spark, memories).link(frame(spark, candidates)).collect()}
    assert set(got) == set(want) and all(got[i] in want[i] for i in got)

    linker, parts = start(spark, memories), {}
    for lo, hi in ((0, 60), (60, 106), (106, 204)):
        batch = [c for c in candidates if lo <= c[1] < hi and not (c[0] == "c005" and c[1] == 200)]
        parts |= {r.id: r.original_id for r in linker.link(frame(spark, batch)).collect()}
    assert parts == got
    reps = {r.id: r.rep for r in linker.clusters().collect()}
    assert len(reps) == len(memories) + len({c[0] for c in candidates})
    assert all(reps[i] == reps[o] for i, o in got.items())


def test_empty_history_and_batch(spark):
    linker = Linker(spark, Scratch(spark, "test").path, 0)
    linker.bootstrap(spark.createDataFrame([], "id string, title string, lesson string"))
    assert linker.link(frame(spark, [])).count() == 0
    assert [tuple(r)[:2] for r in linker.link(frame(spark, [("a", 1, "one two three", "x"), ("b", 1, "one two three", "x"), (None, 2, "one two three", "x")])).collect()] == [("b", "a")]


def test_weights_rise_with_agreement():
    patterns = [(0, 0, 900), (1, 0, 60), (0, 1, 50), (3, 3, 80), (3, 2, 30), (2, 3, 20), (2, 2, 5)]
    w = learn_weights(patterns)
    assert (w[:, 3] > w[:, 0]).all() and (w[:, 3] > 0).all() and (w[:, 0] < 0).all()
    assert learn_weights([]).shape == (2, 4)


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(3)
    sets = [rng.integers(-(2**63), 2**63, 100, dtype=np.int64) for _ in range(2000)]
    one, two = [w[:80] for w in sets], [np.concatenate([w[:60], w[80:]]) for w in sets]  # 60 of 100 words in common
    met = [(bands(one, linkage.BANDS, linkage.ROWS, s) == bands(two, linkage.BANDS, linkage.ROWS, s)).any(1) for s in (1, 2)]
    assert (~(met[0] & met[1])).sum() <= 15


def test_a_small_batch_reads_as_much_from_a_long_history_as_from_a_short_one(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    memories = [(f"m{i:05d}", f"title {i}", " ".join(rng.sample(words, 30))) for i in range(3000)]
    read = {}
    for n in (300, 3000):
        linker = Linker(spark, Scratch(spark, "test").path, n, folder_rows=500)
        linker.bootstrap(spark.createDataFrame(memories[:n], "id string, title string, lesson string"))
        batch = frame(spark, [("c1", 1, *memories[17][1:]), ("c2", 2, "other", "one two three")])
        seen = {}
        kept = linker.kept

        def counted(name, wanted=None, rows=0, kept=kept, seen=seen):
            t = kept(name, wanted, rows)
            seen[name] = seen.get(name, 0) + t.count()
            return t

        linker.kept = counted
        assert {r.id: r.original_id for r in linker.link(batch).collect()} == {"c1": "m00017"}
        read[n] = seen
    # Two candidates have 96 keys: fewer than the long history's 288 folders of keys, more than the short one's 29.
    assert read[3000]["keys"] < 96 * 520 and read[3000]["records"] < 1.2 * max(read[300]["records"], 1000) and read[3000]["clusters"] < 2100


def test_keys_that_very_many_records_share(spark, monkeypatch):
    monkeypatch.setattr(linkage, "meeting", lambda keyed, scratch, count: meeting(keyed, scratch, count, most=6, wide=10))
    memories, candidates = data(4)
    many = [(f"x{i:03d}", "title 3", memories[3][2] + f" only{i}") for i in range(80)]
    more = [(f"y{i:03d}", 300 + i, "title 40", " ".join(f"s{k}" for k in range(60)) + f" only{i}") for i in range(60)]
    want = brute(memories + many, candidates + more)
    got = {r.id: r.original_id for r in start(spark, memories + many).link(frame(spark, candidates + more)).collect()}
    assert set(got) == set(want) and all(got[i] in want[i] for i in got)


def test_parts_find_the_same_and_sketches_are_not_kept_with_keys(spark, monkeypatch):
    memories, candidates = data(4)
    want = brute(memories, candidates)
    for name, value in (("BROADCAST_ROWS", 0), ("PASS_KEYS", 900), ("PASS_PAIRS", 100)):
        monkeypatch.setattr(linkage, name, value)
    parts, run = [], linkage.meeting
    monkeypatch.setattr(linkage, "meeting", lambda keyed, scratch, count: parts.append(keyed.count()) or run(keyed, scratch, count))
    linker = start(spark, memories)
    got = {r.id: r.original_id for r in linker.link(frame(spark, candidates)).collect()}
    assert set(got) == set(want) and all(got[i] in want[i] for i in got)
    # A row of the kept keys is a key and an id, and a part of the bands crosses the network at a time.
    assert linker.kept("keys").columns == ["key", "id"]
    assert len(parts) > 4 and max(parts) < 0.3 * sum(parts)


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    Scratch(spark, "test").keep(spark.range(1000).repartition(3, "id"), "t")
    for _ in range(50):  # they are deleted in the background
        if files() <= before:
            return
        time.sleep(0.2)
    raise AssertionError(files() - before)
