import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import records as rec
from sessionloom.operators import search, transcripts
from sessionloom.operators import prefix_join
from sessionloom.operators.components import components
from sessionloom.operators.prefix_join import joined_classes, nearest, similar_classes
from sessionloom.plans import core
from sessionloom.plans import store as store_plans

ROWS = "id string, title string, trigger_text string, lesson string, domain array<string>, project string, type string, status string, confidence double, updated_at string"


def store(spark, rows):
    base = dict(id="", title="", trigger_text="", lesson="", domain=["d"], project="p", type="pitfall", status="active", confidence=0.5, updated_at="2026-01-01T00:00:00Z")
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], ROWS)


def test_bm25_equals_the_formula(spark):
    rows = [{"id": "a", "title": "aaaa bbb", "lesson": "aaa"}, {"id": "b", "lesson": "bbb 同步队列", "status": "archived"}, {"id": "c", "trigger_text": "nothing", "domain": None}, {"id": "d", "title": None, "lesson": "队列 aaa"}]
    got = {r.id: r.score for r in search.bm25(store(spark, rows), "aaa 步队列 io", status="active").collect()}
    size = lambda *f: float(sum(max(len(x) - 2, 0) for x in f))
    d = {"a": size("aaaa bbb", "aaa", "d"), "b": size("bbb 同步队列", "d"), "c": size("nothing"), "d": size("队列 aaa", "d")}
    avg = sum(d.values()) / 4
    part = lambda f, n, x: max(math.log((4 - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d[x] / avg))
    assert got == pytest.approx({"a": -part(3, 2, "a"), "d": -part(1, 2, "d")})
    assert search.bm25(store(spark, rows), "io").count() == 0


def test_short_words_and_wildcards(spark):
    t = store(spark, [{"id": "a", "title": "x IO y", "status": "superseded"}, {"id": "b", "lesson": "vm"}, {"id": "c", "title": "100%", "confidence": 0.9}, {"id": "d", "title": "vm io", "confidence": 0.9}])
    assert [r.id for r in search.like(t, "vm io", 10, status="active").collect()] == ["d", "b"]
    assert search.like(t, "%", 10).count() == 0


def test_weighted_scan(spark):
    t = store(spark, [{"id": "a", "title": "ab ab", "domain": ["ab"]}, {"id": "b", "trigger_text": "AB", "lesson": "ab"}, {"id": "c"}])
    assert [(r.id, r.score) for r in search.weighted_scan(t, "ab", 10).collect()] == [("a", -8.0), ("b", -3.0)]


def test_reranking(spark):
    t = store(spark, [{"id": "a"}, {"id": "b", "updated_at": "2026-05-20T00:00:00Z"}, {"id": "c", "confidence": 0.95, "domain": ["e"]}]).withColumn("score", F.lit(-1.0))
    merit = {r.id: r.merit for r in search.reranked(t, "2026-06-01T00:00:00Z").collect()}
    assert merit == pytest.approx({"a": -0.5, "b": 1 - 0.5 - 0.75, "c": 2 - 0.95})
    assert [r.id for r in search.reranked(t, "2026-06-01T00:00:00Z", domain="e").collect()] == ["c"]


def test_similar_classes_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    rows = [(f"i{i:03d}", rng.choice("xy"), " ".join(rng.choices(words, k=rng.randrange(0, 8)))) for i in range(120)] + [("p1", "x", "!!"), ("p2", "x", " !! "), ("n", "x", None), (None, "x", "w1"), ("q", None, "w1")]
    for t in (0.35, 0.6, 1.0):
        membership, links = similar_classes(spark.createDataFrame(rows, "id string, block string, text string"), t)
        cls = {(r.id, r.block): r.class_id for r in membership.collect()}
        first: dict = {}
        for i, b, x in sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[0]):
            s = frozenset((x or "").split()) - {"!!"}
            key = (b, s or (x or "").strip())
            assert cls[i, b] == first.setdefault(key, i)
        sets = [(b, k if isinstance(k, frozenset) else frozenset(), i) for (b, k), i in first.items()]
        want = {(b, min(i, j), max(i, j)) for b, s, i in sets for c, u, j in sets if b == c and i < j and s and u and len(s & u) >= t * len(s | u)}
        assert {(r.block, r.a, r.b) for r in links.collect()} == want


def test_clusters_cap_and_tags(spark):
    rows = [(f"m{i:02d}", ["t", "t", "u"], "same title here", 0.5 + i / 100) for i in range(14)] + [("z1", ["u"], "other thing", 0.5), ("z2", ["u"], "other thing too", 0.5), ("z3", None, "other thing", 0.1)]
    got = {(r.domain, r.size, r.members) for r in rec.clusters(spark.createDataFrame(rows, "id string, domain array<string>, text string, confidence double")).collect()}
    assert got == {("t", 12, ",".join(f"m{i:02d}" for i in range(2, 14))), ("u", 2, "z1,z2")}


@pytest.mark.parametrize(("chunk", "held"), [(1 << 14, 1 << 20), (9, 3)])
def test_joined_classes_join_what_the_links_join(spark, monkeypatch, chunk, held):
    run = prefix_join._joined
    monkeypatch.setattr(prefix_join, "_joined", lambda threshold: run(threshold, held))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"i{i:03d}", rng.choice("xxy"), " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(200)] + [("n", "x", None), ("p1", "x", "!!")]
    df = spark.createDataFrame(rows, "id string, block string, text string")
    node = lambda c: F.xxhash64("block", F.col(c))
    for t in (0.35, 0.6, 1.0):
        membership, links = similar_classes(df, t)
        got_membership, edges = joined_classes(df, t, chunk=chunk)
        assert set(got_membership.collect()) == set(membership.collect())
        want = {r.node: r.root for r in components(links.select(node("a").alias("a"), node("b").alias("b"))).collect()}
        assert {r.node: r.root for r in components(edges).collect()} == want and (want or t == 1.0)
    assert joined_classes(df.limit(0), 0.35)[1].count() == 0


def shuffled(spark):
    """Rows that all stages so far wrote for a shuffle."""
    gw = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_chunks_meet_in_rounds(spark):
    rows = [(f"m{i:03d}", "t", f"order of things matters here only{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, block string, text string")
    gw = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
    seen = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    _, edges = joined_classes(df, 0.35, chunk=30)
    after = stages()
    assert max(after.apply(i).shuffleWriteRecords() for i in range(after.size()) if after.apply(i).stageId() > seen) < 5 * 300  # all chunks at once: 3,000
    assert components(edges).select("root").distinct().count() == 1 and components(edges).count() == 300


def test_clusters_shuffle_no_pairs(spark):
    rows = [(f"m{i:03d}", ["t"], f"order of things matters here only{i}", 0.5) for i in range(300)]
    before = shuffled(spark)
    (got,) = rec.clusters(spark.createDataFrame(rows, "id string, domain array<string>, text string, confidence double")).collect()
    assert (got.size, got.members) == (12, ",".join(f"m{i:03d}" for i in range(12)))
    assert shuffled(spark) - before < 30 * 300  # 44,850 pairs are alike


def test_cluster_tags_shuffle_no_pairs(spark, tmp_path):
    tag = rec.DERIVED + ",".join(f"m{i:03d}" for i in range(12))
    rows = [(f"m{i:03d}", "1", "active", ["t"], f"order of things matters here only{i}", None, 0.5, None, None) for i in range(300)] + [("a", "1", "active", ["t"], "order of things matters here", None, 0.9, [tag], None)]
    spark.createDataFrame(rows, "id string, updated_at string, status string, domain array<string>, title string, trigger_text string, confidence double, notes array<string>, loaded_at timestamp").write.parquet(str(tmp_path / "memories.parquet"))
    before = shuffled(spark)
    assert [tuple(r) for r in store_plans.cluster_tags(spark, str(tmp_path)).collect()] == [(tag[len(rec.DERIVED) :], tag, True)]
    assert shuffled(spark) - before < 30 * 300


def greedy(rows):
    pool = []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        for m in pool:
            if (m["session"], m["type"]) != (r[1], r[3]):
                continue
            a, b = set(m["title"].split()), set(r[4].split())
            if m["trigger"] == r[5] or (len(a & b) >= 0.6 * len(a | b) if a | b else True):
                if len(r[6]) > len(m["lesson"]):
                    m.update(id=r[0], title=r[4], trigger=r[5], lesson=r[6])
                m["cited"] = list(dict.fromkeys(m["cited"] + [e[0].lstrip("#") for e in r[8]]))
                m["salience"], m["n"] = max(m["salience"], r[7]), m["n"] + 1
                break
        else:
            pool.append(dict(id=r[0], session=r[1], type=r[3], title=r[4], trigger=r[5], lesson=r[6], salience=r[7], n=0, cited=list(dict.fromkeys(e[0].lstrip("#") for e in r[8]))))
    return {(m["id"], m["title"], m["salience"], m["n"], ",".join(m["cited"])) for m in pool}


def test_pool_dedup_equals_the_sequential_fold(spark):
    rng = random.Random(8)
    words = list("abcdefg")
    rows = [(f"c{i:03d}", rng.choice("st"), rng.randrange(90), rng.choice(["pitfall", "decision"]), " ".join(sorted(rng.sample(words, rng.randrange(1, 6)))), f"t{rng.randrange(40)}", "x" * rng.randrange(9), float(rng.randrange(9)), [(rng.choice(["#m1", "m2", "m3"]),)], False, ["d"]) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, session_id string, pos int, type string, title string, trigger_text string, lesson string, salience double, evidence array<struct<message_id string>>, volatile boolean, domain array<string>")
    got = {(r.id, r.title, r.salience, r.merged, r.cited) for r in rec.deduplicated(df).collect()}
    assert got == greedy(rows)
    assert rec.deduplicated(df.limit(0)).count() == 0


def test_consensus(spark):
    t = spark.createDataFrame([("a", 7.0), ("a", 3.0), ("a", 9.0), ("a", 4.0), ("a", 99.0), ("b", None), (None, 1.0)], "k string, v double")
    assert sorted(map(tuple, rec.consensus(t, "k", "v").collect())) == [("a", 4.0, 4, 5), ("b", None, 0, 1)]


def test_validation_reasons(spark):
    schema = "id string, session_id string, type string, title string, trigger_text string, lesson string, domain array<string>, evidence array<struct<message_id string>>, salience double, volatile boolean"
    good = ("a", "s", "pitfall", "t", "t", "l", ["d"], [("#m",)], 5.0, False)
    bad = ("b", "s", "odd", " ", None, "w " * 81, [], [("x",), (None,)], None, None)
    known = spark.createDataFrame([("s", "m"), ("r", "x")], "session_id string, message_id string")
    got = {r.id: r.reasons for r in rec.validated(spark.createDataFrame([good, bad, bad], schema), known).collect()}
    assert got["a"] == [] and got["b"] == ["type", "title", "trigger_text", "lesson exceeds 80 words", "domain", "evidence without message", "unknown message", "salience", "volatile"]


def test_upsert(spark):
    s = "id string, v int, status string, made string"
    base, changes = spark.createDataFrame([("a", 1, "x", "old"), ("b", 1, "x", "old")], s), spark.createDataFrame([("a", 2, "y", "new"), ("a", 3, "z", "new"), ("c", 1, "w", "new"), (None, 1, "q", "q")], s)
    got = {r.id: tuple(r)[1:] for r in rec.merged_by_key(base, changes, "id", ["v"], ["made"]).collect()}
    assert got == {"a": (3, "z", "old", "update"), "b": (1, "x", "old", "keep"), "c": (1, "w", "new", "insert")}


def test_transcript(spark):
    when = "time_created long, time_updated long, data string, loaded_at timestamp"
    m = spark.createDataFrame([("m1", "s", 60000, 1, '{"role":"user"}', None), ("m1", "s", 60000, 0, '{"role":"assistant"}', None), ("m2", "s", 120000, 1, '{"role":"assistant","modelID":"k"}', None), ("m3", "s", 180000, 1, '{"ro', None), ("m4", "s", 190000, 1, '{"role":"user"}', None)], f"id string, session_id string, {when}")
    tool = '{"type":"tool","tool":"bash","state":{"input":{"z":1,"a":"' + "y" * 200 + '"}}}'
    p = spark.createDataFrame([("p1", "m1", "s", 1, 1, '{"type":"text","text":" hi "}', None), ("p2", "m2", "s", 1, 1, '{"type":"step-start"}', None), ("p3", "m2", "s", 1, 1, tool, None), ("p4", "m4", "s", 1, 1, '{"type":"text","text":" "}', None), ("p5", "m3", "s", 1, 1, '{"type":"text","text":"lost"}', None)], f"id string, message_id string, session_id string, {when}")
    (r,) = transcripts.rendered(m, p).collect()
    shown = ('{"z":1,"a":"' + "y" * 200)[:160]
    assert r.body == f"## T1 [00:01] User {{#m1}}\n\nhi\n\n## T2 [00:02] Assistant {{#m2}}\n\n> 🔧 bash {shown}… → ?\n"
    assert (r.turns, r.user_turns) == (2, 1)


def test_nearest(spark):
    q = spark.createDataFrame([("q", "red fox"), ("r", None)], "query_id string, text string")
    d = spark.createDataFrame([("a", "red red fox"), ("b", "red"), ("c", "blue"), (None, "red")], "id string, text string")
    assert [(r.id, r.rank) for r in nearest(q, d, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_changed_session_is_unprocessed_again(spark, tmp_path):
    when = "time_created long, time_updated long, data string, loaded_at timestamp"
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("sessions", [(i, 1, None, "/x/p", None) for i in ("same", "changed", "older", "empty", "new")], "id string, time_updated long, parent_id string, directory string, loaded_at timestamp")
    said = ("same", "changed", "older", "new")
    write("messages", [(f"m-{i}", i, 60000, 1, '{"role":"user"}', None) for i in said], f"id string, session_id string, {when}")
    write("parts", [(f"p-{i}", f"m-{i}", i, 1, 1, '{"type":"text","text":"hi"}', None) for i in said], f"id string, message_id string, session_id string, {when}")
    hashed = {i: "sha256:" + hashlib.sha256(b.encode()).hexdigest()[:16] for i, b in {**{i: f"## T1 [00:01] User {{#m-{i}}}\n\nhi\n" for i in said}, "empty": ""}.items()}
    ledger = [("same", hashed["same"], "1"), ("changed", "sha256:00", "1"), ("older", hashed["older"], "0"), ("empty", hashed["empty"], "1"), (None, hashed["new"], "1")]
    write("ledger", ledger, "session_id string, content_hash string, pipeline_version string")
    got = {(r.session_id, r.content_hash) for r in core.unprocessed_versions(spark, str(tmp_path)).collect()}
    assert got == {(i, hashed[i]) for i in ("changed", "older", "new")}
