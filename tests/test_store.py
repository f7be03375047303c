import random

from pyspark.sql import functions as F

from sessionloom.operators import records, search, transcripts
from sessionloom.sources import files


def test_cut_counts_utf16_units(spark):
    texts = ["a" * 10, "a" * 11, "😀" * 5, "😀" * 6, "a" + "😀" * 5, None, ""]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(transcripts.cut_units(F.col("t"), 10).alias("x")).collect()]
    assert got == ["a" * 10, "a" * 10, "😀" * 5, "😀" * 5, "a" + "😀" * 4 + "�", None, ""]


def test_export_outcomes(spark):
    sessions = [("ok", None, "/w/Proj A/"), ("same", " ", "/w/b"), ("child", "ok", "/w/b"), ("slug", "null", "/w/secret"), ("part", "", "/w/not-this/x"), ("few", None, "/w/b"), ("bare", None, None)]
    s = spark.createDataFrame(sessions, "id string, parent_id string, directory string")
    b = spark.createDataFrame([("ok", 2, "h1"), ("same", 3, "h2"), ("child", 3, "h3"), ("slug", 3, "h4"), ("part", 3, "h5"), ("few", 1, "h6"), ("lost", 4, "h7")], "session_id string, user_turns long, content_hash string")
    e = spark.createDataFrame([("ok", "old"), ("same", "h2")], "session_id string, exported_hash string")
    got = {r.session_id: (r.outcome, r.reason, r.slug) for r in transcripts.export_outcomes(s, b, e, ("secret", "not-this")).collect()}
    assert got == {
        "ok": ("written", None, "proj-a"), "same": ("unchanged", None, "b"), "child": ("skipped", "child session", "b"), "slug": ("skipped", "ignored project", "secret"),
        "part": ("skipped", "ignored project", "x"), "few": ("skipped", "too few user turns", "b"), "bare": ("skipped", "too few user turns", "unknown"), "lost": ("skipped", "not found", None),
    }


def test_bundles_of_one_and_all_sessions(spark):
    s = spark.createDataFrame([("s", 1, None), ("t", 1, None)], "id string, time_updated long, loaded_at timestamp")
    m = spark.createDataFrame([("m2", 1, "s", 5, "{}", None), ("m1", 1, "s", 5, "[]", None), ("m3", 1, "s", 4, "nope", None), ("m4", 1, "t", 1, "{}", None), ("m5", 1, "gone", 1, "{}", None), ("m6", 1, None, 1, "{}", None)], "id string, time_updated long, session_id string, time_created long, data string, loaded_at timestamp")
    p = spark.createDataFrame([("p2", 1, "m1", "s", "{}", None), ("p1", 1, "m1", "s", "{}", None), ("p3", 1, "m1", "s", "3", None)], "id string, time_updated long, message_id string, session_id string, data string, loaded_at timestamp")
    rows = sorted(map(tuple, transcripts.bundles(s, m, p).collect()), key=str)
    assert rows == [("s", "m1", 0, "p1", 0), ("s", "m1", 0, "p2", 1), ("s", "m2", 1, None, None), ("t", "m4", 0, None, None)]
    assert {r.session_id for r in transcripts.bundles(s, m, p, "t").collect()} == {"t"}


def test_unique_ids_are_those_of_one_after_another(spark):
    rng = random.Random(3)
    made = [(f"i{k:03d}", rng.choice(["b", "c", "d"])) for k in range(60)]
    taken = ["b", "b-2", "b-4", "c-3", "e", "c-x", None]
    used, want = set(taken), {}
    for i, base in made:
        n = 1
        while (base if n == 1 else f"{base}-{n}") in used:
            n += 1
        want[i] = base if n == 1 else f"{base}-{n}"
        used.add(want[i])
    got = records.unique_ids(spark.createDataFrame(made, "id string, base string"), spark.createDataFrame([(t,) for t in taken], "taken string"), ["id"])
    assert {r.id: r.unique_id for r in got.collect()} == want


def test_catalog_lines(spark):
    rows = [("a", "p", "pitfall", "T", 0.5, "active"), ("b", "p", "decision", None, 1.0, "candidate"), ("c", "p", "decision", "U", 0.65, "active"), ("q", "p", "decision", "V", 0.9, "quarantined"), ("q", "p", "decision", "V", 0.9, "quarantined"), ("z", None, "decision", "W", 0.9, "active"), ("x", "p", "decision", "W", 0.9, "archived")]
    got = sorted((r.section, r.place, r.line) for r in records.catalog_lines(spark.createDataFrame(rows, "id string, project string, type string, title string, confidence double, status string")).collect())
    assert got == [("project p", 0, "- [](memories/p/b.md) — decision, confidence 1, candidate"), ("project p", 1, "- [U](memories/p/c.md) — decision, confidence 0.65, active"), ("project p", 2, "- [T](memories/p/a.md) — pitfall, confidence 0.5, active"), ("quarantine", 0, "- q: V")]


def test_tags_match_whole_only(spark):
    groups = spark.createDataFrame([("a,b",), ("a,b,c",)], "members string")
    notes = spark.createDataFrame([(["x derived from: a,b,c"],), (["derived from: a,b,c more"],), (None,)], "notes array<string>")
    assert {r.members: r.known for r in records.tagged_clusters(groups, notes).collect()} == {"a,b": False, "a,b,c": True}


def test_case_scores(spark):
    items = [(1, "pitfall", "stale guard"), (1, "decision", "Guard"), (1, "decision", None), (2, "pitfall", "nothing")]
    t = spark.createDataFrame(items, "run int, type string, text string")
    cases = [("c", [((), ("guard",), 2), (("pitfall",), ("stale", "guard"), 1)], [(("decision",), ("legacy",), 1)], 1, None), ("d", [], [((), ("nothing",), 1)], None, 3)]
    got = {(r.run, r.case): (r.met, r.expected, r.forbidden, r.extras, r.total, r.passed) for r in records.case_scores(t, ["run"], cases, F.col("text")).collect()}
    assert got == {(1, "c"): (2, 2, 0, 1, 3, True), (2, "c"): (0, 2, 0, 1, 1, False), (1, "d"): (0, 0, 0, 3, 3, True), (2, "d"): (0, 0, 1, 1, 1, False)}
    assert records.case_scores(t.limit(0), ["run"], cases, F.col("text")).count() == 0


def test_search_filters_by_domain_after_the_fetch(spark):
    rows = [(f"m{i:02d}", "guard " * (40 - i), None, None, ["x"] if i == 35 else ["y"], "p", "pitfall", 0.9 if i else 0.3, "active", "2026-01-01T00:00:00Z") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, title string, trigger_text string, lesson string, domain array<string>, project string, type string, confidence double, status string, updated_at string")
    now = "2026-06-15T00:00:00Z"
    assert search.search(df, "guard", now, domain="x").count() == 0  # not among the 30 that are fetched
    assert [r.id for r in search.search(df, "guard", now, domain="x", limit=50).collect()] == ["m35"]
    assert search.search(df, "guard", now, limit=99).count() == 39 and search.search(df, "guard", now, include_tentative=True, limit=99).count() == 40
    assert search.search(df, "guard", now, project="q").count() == 0 and search.search(df, "guard", now, project="p", kind="pitfall").count() == 10
    assert search.by_id(df, "m07").collect()[0].confidence == 0.9 and search.by_id(df, "nope").count() == 0


def test_texts_of_many_lines_survive_their_files(spark, tmp_path):
    texts = ["one\ntwo\n", "", "tab\t---\n", "  blank  "]
    files.write_texts(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), f"{tmp_path}/t")
    assert sorted(r.text for r in files.read_texts(spark, f"{tmp_path}/t").collect()) == sorted(texts)


def test_removed(spark):
    t = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assert {r.id for r in records.removed(t, spark.createDataFrame([("a",), (None,), ("a",)], "id string")).collect()} == {"b", None}
