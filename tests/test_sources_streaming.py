import json

from pyspark.sql import functions as F

from sessionloom.sources import files
from sessionloom.streaming.incremental import run_new, silent_sessions

RECORD = "id string, memory_class string, type string, title string, trigger_text string, project string, scope string, domain array<string>, volatile boolean, confidence double, status string, superseded_by string, supersedes string, promoted_from string, absorbs array<string>, review string, evidence array<struct<session string, anchors array<string>, observed_at string>>, provenance struct<extractor string, prompt_hash string>, created_at string, updated_at string, lesson string, notes array<string>"


def row(**change):
    base = dict(id="mem_1", memory_class="semantic", type="pitfall", title="A: \"b\" 12", trigger_text="null", project="p", scope="project", domain=["x", "y z"], volatile=True, confidence=0.65, status="active", superseded_by=None, supersedes=None, promoted_from=None, absorbs=None, review="auto", evidence=[("s", ["m1", "m2"], "2026-01-01T00:00:00.000Z")], provenance=("e", "sha256:1"), created_at="2026-01-01T00:00:00.000Z", updated_at="2026-01-02T00:00:00.000Z", lesson="Line one\n\n---\nline two 同步", notes=["first \\ note", "- second"])
    return tuple((base | change).values())


def test_records_survive_a_round_trip(spark, tmp_path):
    rows = [row(), row(id="mem_2", title="12", lesson="x", notes=[], absorbs=["mem_1"]), row(id="mem_3", title="true", trigger_text=" padded ", superseded_by="mem_1", domain=[])]
    df = spark.createDataFrame(rows, RECORD)
    files.write_files(df.select(F.concat("project", F.lit("/"), "id", F.lit(".md")).alias("path"), files.record_text().alias("text")), str(tmp_path))
    back = files.records(files.markdown_files(spark, str(tmp_path)))
    assert back.where("size(errors) > 0").count() == 0
    same = back.select(*df.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, df.collect()))


def test_broken_records_name_their_fields(spark):
    t = spark.createDataFrame([("a", "no front matter"), ("b", "---\nid: x\ntype: odd\nconfidence: 3\n---\n\nbody\n"), ("c", None)], "path string, text string")
    got = {r.path: set(r.errors) for r in files.records(t).collect()}
    assert "front matter" in got["a"] and {"type", "confidence", "title", "superseded_by"} <= got["b"] and "front matter" in got["c"]


def test_transcripts(spark, tmp_path):
    good = '---\nsession_id: s1\ntitle: "a: \\"b\\""\ncontent_hash: sha256:1\ntime_end: 2026-01-01T00:00:00.000Z\nexported_at: 2026-01-02T00:00:00.000Z\n---\n## T1\n\nhi'
    for name, text in {"p/one.md": good, "p/two.md": good.replace('"a: \\"b\\""', '""'), "three.md": "x", "four.txt": good}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (r,) = files.transcripts(files.markdown_files(spark, str(tmp_path))).collect()
    assert (r.project, r.session_id, r.title, r.body) == ("p", "s1", 'a: "b"', "## T1\n\nhi")


def test_ledger_skips_torn_lines(spark, tmp_path):
    at = tmp_path / "ledger.jsonl"
    at.write_text(json.dumps(dict(session_id="s", content_hash="h", pipeline_version="1", n_candidates=2)) + '\n{"session_id": "t", "content_h\n{"session_id": "u"}\n\n{"session_id"')
    assert [r.session_id for r in files.ledger(spark, str(at)).collect()] == ["s"]
    assert files.unreadable_lines(spark, str(at)) == 2
    files.append_ledger(files.ledger(spark, str(at)), str(tmp_path / "more"))
    assert files.ledger(spark, str(tmp_path / "more")).count() == 1


def test_new_files_are_worked_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    call = lambda: run_new(spark, source, "k string, v int", str(tmp_path / "state"), ["k"], lambda d: d.select("k", (F.col("v") * 2).alias("w")), out)
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int").write.parquet(source)
    call()
    spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int").write.mode("append").parquet(source)
    call()
    call()
    assert sorted((r.k, r.w) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 4), ("c", 6)]


def test_silent_sessions(spark, tmp_path):
    rows = [("s", "2026-01-01 00:00:00"), ("s", "2026-01-01 03:00:00"), ("s", "2026-01-01 12:00:00"), ("t", "2026-01-02 00:00:00"), ("t", "2026-01-03 00:00:00")]
    spark.createDataFrame(rows, "session_id string, t string").select("session_id", F.to_timestamp("t").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = silent_sessions(spark.readStream.schema("session_id string, at timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("silent").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session_id, r.messages) for r in spark.sql("SELECT * FROM silent").collect()}
    assert {("s", 2), ("s", 1), ("t", 1)} <= got
