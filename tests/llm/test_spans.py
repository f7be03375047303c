import random
from itertools import combinations

import numpy as np
import pytest

from sessionloom.llm.spans import WINDOW, covered, named_in_rounds, p8_spans, runs, shared_spans, symbols, whole_spans
from sessionloom.runtime import Scratch


def brute(texts, least):
    grams: dict = {}
    for d, t in texts.items():
        for i in range(len(t or "") - least + 1):
            grams.setdefault(t[i : i + least], []).append((d, i))
    pairs, marks = set(), {d: set() for d in texts}
    for places in grams.values():
        docs = {d for d, _ in places}
        if len(docs) > 1:
            pairs |= {tuple(sorted(p)) for p in combinations(docs, 2)}
            for d, i in places:
                marks[d] |= set(range(i, i + least))
    return pairs, {d: len(m) for d, m in marks.items() if m}


def prose(rng, n):
    return "".join(rng.choice(["the ", "cache ", "row_", "42", ", ", "同步", "队列", "\n", "Fenoxa-kit ", "é", "🔧", "drops ", "index "]) for _ in range(n))


def corpus(seed, hot):
    rng = random.Random(seed)
    texts = {i: prose(rng, 260) for i in range(40)}
    for i in range(0, 30, 2):  # exactly 200 characters, and some just short of it, at random places
        a, b, n = texts[i], texts[i + 1], rng.choice([199, 200, 201, 260, 400])
        at, to = rng.randrange(max(1, len(a) - n)), rng.randrange(len(b))
        texts[i + 1] = b[:to] + a[at : at + n] + b[to:]
    texts[40] = "-" * 500 + prose(rng, 30)
    texts[41] = prose(rng, 30) + "-" * 300
    texts[42] = "ab" * 400
    texts[43] = "x" + "ab" * 150
    shared = prose(rng, 90)[:260]
    for i in range(100, 100 + hot):
        texts[i] = prose(rng, 60) + shared + prose(rng, 40)
    short = prose(rng, 60)[:150]
    for i in range(200, 200 + hot):
        texts[i] = prose(rng, 60) + short + prose(rng, 40)
    texts[300], texts[301] = texts[0], texts[0]
    texts[302], texts[303] = None, ""
    return texts


@pytest.mark.parametrize(("seed", "hot", "bucket"), [(1, 3, 64), (2, 12, 4)])
def test_pairs_and_coverage_equal_brute_force(spark, seed, hot, bucket):
    texts = corpus(seed, hot)
    pairs, marks = brute(texts, 200)
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, key int")
    spans, hot_rows = shared_spans(df, bucket=bucket)
    got = {(r.doc_a, r.doc_b) for r in spans.collect()}
    by: dict = {}
    for r in hot_rows.collect():
        by.setdefault(r.key, set()).add(r.doc_id)
    got |= {tuple(sorted(p)) for docs in by.values() for p in combinations(docs, 2)}
    assert got == pairs
    share = {r.doc_id: r.shared_chars for r in covered(spans, hot_rows).collect()}
    assert share == marks
    for r in spans.collect():
        assert texts[r.doc_a][r.start_a : r.start_a + r.length] == texts[r.doc_b][r.start_b : r.start_b + r.length]


def test_names_agreed_in_rounds_give_the_same_pairs(spark):
    texts = corpus(1, 3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans, hot = shared_spans(df, in_rounds=True)
    got = {(r.doc_a, r.doc_b) for r in spans.collect()}
    by: dict = {}
    for r in hot.collect():
        by.setdefault(r.key, set()).add(r.doc_id)
    assert got | {tuple(sorted(p)) for docs in by.values() for p in combinations(docs, 2)} == brute(texts, 200)[0]
    # Names and fingerprints cut an equal stretch alike: the same text has the same symbols under both.
    d = df.where("length(text) >= 200")
    named = {}
    for r in named_in_rounds(d, Scratch(spark, "test")).collect():
        named.setdefault(r.name, set()).add(texts[r.doc][r.pos : r.pos + r.size])
    assert all(len(x) == 1 for x in named.values()) and max(len(next(iter(x))) for x in named.values()) > 20


@pytest.mark.parametrize(("seed", "hot", "bucket"), [(1, 3, 64), (2, 12, 4)])
def test_whole_spans_reach_every_shared_place(spark, seed, hot, bucket):
    texts = corpus(seed, hot)
    pairs, marks = brute(texts, 200)
    rows = whole_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bucket=bucket).collect()
    seen, got, by = {}, set(), {}
    for r in rows:
        a, b, n = texts[r.doc_a], texts[r.doc_b], r.length
        i, j = r.start_a, r.start_b
        assert a[i : i + n] == b[j : j + n] and n >= 200 and r.doc_a < r.doc_b
        assert i == 0 or j == 0 or a[i - 1] != b[j - 1]
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]
        got.add((r.doc_a, r.doc_b))
        for doc, at in ((r.doc_a, i), (r.doc_b, j)):
            seen.setdefault(doc, set()).update(range(at, at + n))
        if r.many:
            by.setdefault(r.doc_a, []).append((i, i + n, r.doc_b))
    for places in by.values():  # two places share what their spans have in common at the one place
        got |= {tuple(sorted((x[2], y[2]))) for x, y in combinations(places, 2) if x[2] != y[2] and min(x[1], y[1]) - max(x[0], y[0]) >= 200}
    assert got == pairs
    share = {doc: len(m) for doc, m in seen.items()}
    assert share == marks


def test_header_on_more_places_than_the_bucket(spark, tmp_path):
    rng = random.Random(8)
    header = prose(rng, 90)[:260]
    texts = {i: header + chr(0x4E00 + i) + prose(rng, 60) for i in range(70)}
    ends = [prose(rng, 400)[:900] for _ in range(2)]  # a span of two texts with the header, hot, in its middle
    middle = ends[0] + "".join(header for _ in range(8)) + ends[1]
    texts[70], texts[71] = "<a" + middle + "b>", "<c" + middle + "d>"
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = p8_spans(spark, str(tmp_path)).collect()
    assert {(0, i, 0, 0, 260) for i in range(1, 70)} <= {(r.doc_a, r.doc_b, r.start_a, r.start_b, r.length) for r in rows}
    assert {(r.start_a, r.start_b) for r in rows if (r.doc_a, r.doc_b, r.length) == (70, 71, len(middle))} == {(2, 2)}
    assert not any((r.doc_a, r.doc_b) == (70, 71) and r.start_a == r.start_b and r.length < len(middle) for r in rows)


def test_no_documents(spark):
    spans, hot = shared_spans(spark.createDataFrame([], "doc_id long, text string"))
    assert spans.count() == hot.count() == 0
    assert whole_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_stretches_hold_equal_runs():
    rng = random.Random(5)

    def keys(t):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        at, fingerprint = symbols(codes, np.array([0]))
        keep, end = runs(at, np.full(len(at), len(codes)), WINDOW)
        return set(fingerprint(at[keep], end).tolist())

    missed = 0
    for _ in range(600):
        piece = prose(rng, 120)[:200]
        missed += not keys(prose(rng, 60) + piece + prose(rng, 60)) & keys(prose(rng, 60) + piece + prose(rng, 60))
    assert missed == 0
