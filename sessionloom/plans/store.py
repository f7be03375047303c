"""Queries over exports, stored files, statistics and scores, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import text as fx
from sessionloom.operators import records as rec
from sessionloom.operators import search, transcripts
from sessionloom.operators.prefix_join import nearest
from sessionloom.operators.runs import running_totals
from sessionloom.plans import core
from sessionloom.plans.core import NOW, memories
from sessionloom.runtime import Scratch, in_force, table
from sessionloom.sources import files
from sessionloom.streaming.incremental import run_new, silent_sessions

#: Sessions were exported before at this moment, from the rows that had come by then.
EXPORTED = "2026-05-01 00:00:00"
IGNORED = ("unknown", "fenlan")
MIN_USER_TURNS = 2


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "time_updated", "parent_id", "directory", "title", "time_created", "tokens_input", "tokens_output"]
    return in_force(table(spark, sf_dir, "sessions"), "id", "time_updated", cols)


def root_sessions(spark, sf_dir):
    """Sessions without a parent in order of their last change."""
    s = _sessions(spark, sf_dir).where(transcripts.is_root("parent_id")).select("id", "time_updated", F.lit(0).alias("all"))
    return running_totals(s, ["all"], ["time_updated", "id"], {"place": "1"}).select("id", "place")


def session_bundles(spark, sf_dir):
    """Every session's readable messages in order of time, with their readable parts in order of id (part -1: none)."""
    t = transcripts.bundles(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts"))
    return t.withColumn("part_no", F.coalesce("part_no", F.lit(-1).cast("long")))


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts")
    early = F.col("loaded_at") < F.to_timestamp(F.lit(EXPORTED))
    before = transcripts.rendered(m.where(early), p.where(early)).select("session_id", F.col("content_hash").alias("exported_hash"))
    return transcripts.export_outcomes(_sessions(spark, sf_dir), transcripts.rendered(m, p), before, IGNORED, MIN_USER_TURNS)


def export_outcomes(spark, sf_dir):
    return _exports(spark, sf_dir).select("session_id", "outcome", "reason", F.when(F.col("outcome") != "skipped", F.concat("slug", F.lit("/"), "session_id", F.lit(".md"))).alias("path"))


def backfill_counts(spark, sf_dir):
    """Outcomes of exporting all root sessions."""
    t = _exports(spark, sf_dir).where(transcripts.is_root("parent_id") & (F.coalesce("reason", F.lit("")) != "not found"))
    return t.groupBy("outcome").agg(F.count("*").alias("sessions"))


def export_markdown(spark, sf_dir):
    """The hash of each whole transcript file that an export writes."""
    r = transcripts.rendered(table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts"))
    models = transcripts.session_models(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "messages"))
    return transcripts.header(_sessions(spark, sf_dir), r, models, NOW).select("session_id", fx.js_length("markdown").alias("units"), F.sha2("markdown", 256).alias("digest"))


def transcript_triage(spark, sf_dir):
    """Rendered sessions in order of their end: too short to be looked at, too short without a model, or kept."""
    r = transcripts.rendered(table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts"))
    t = _sessions(spark, sf_dir).select(F.col("id").alias("session_id"), "time_updated").join(r, "session_id")
    units = fx.js_length("body")
    t = t.select("session_id", "time_updated", units.alias("units"), F.when(units < 80, "out").when(units < 400, "out without a model").otherwise("kept").alias("verdict"), F.lit(0).alias("all"))
    return running_totals(t, ["all"], ["time_updated", "session_id"], {"seq": "1"}).select("session_id", "units", "verdict", "seq")


def transcript_turns(spark, sf_dir):
    """The rendered turns as rows, which is the form for sessions of any length."""
    return transcripts.turns(table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts"))


def search_domain(spark, sf_dir):
    """The whole search with a domain filter, which follows the fetch and so may leave fewer rows than the limit."""
    t = search.search(memories(spark, sf_dir, core._SEARCHED), core.QUERY, NOW, domain="storage", include_tentative=True, limit=40)
    return t.select("id", "title", "project", "type", "confidence", F.round("merit", 6).alias("merit"))


#: A project that holds about a tenth of the records.
PROJECT = "copper-heron"


def search_project(spark, sf_dir):
    """The whole search inside one project; word statistics are still those of all records."""
    t = search.search(memories(spark, sf_dir, core._SEARCHED), core.QUERY, NOW, project=PROJECT)
    return t.select("id", "title", "project", "type", "confidence", F.round("merit", 6).alias("merit"))


def memory_stats(spark, sf_dir):
    """Records by status and type, processed sessions, the last time of processing, quarantined records."""
    t = memories(spark, sf_dir, ["status", "type"])
    led = table(spark, sf_dir, "ledger").where("session_id IS NOT NULL AND content_hash IS NOT NULL AND pipeline_version IS NOT NULL")
    counted = core.counts_by_status_and_type(spark, sf_dir)
    done = led.agg(F.countDistinct("session_id", "content_hash", "pipeline_version").alias("n"), F.max("processed_at").alias("last"))
    rows = done.select(F.explode(F.array(F.struct(F.lit("processed").alias("facet"), F.lit(None).cast("string").alias("value"), F.col("n")), F.struct(F.lit("last processed").alias("facet"), F.col("last").alias("value"), F.lit(1).cast("long").alias("n")))).alias("r")).select("r.*")
    held = t.agg(F.sum((F.col("status") == "quarantined").cast("long")).alias("n")).select(F.lit("quarantine").alias("facet"), F.lit(None).cast("string").alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    return counted.unionByName(rows).unionByName(held)


def unique_record_ids(spark, sf_dir):
    """Ids made from project, title and day for all memories in order of creation, a suffix from the second on.

    Ids that superseded records have already are taken.
    """
    t = memories(spark, sf_dir, ["project", "type", "title", "created_at", "status"])
    made = t.select("id", F.col("created_at").alias("at"), fx.record_id("project", "type", F.to_timestamp("created_at")).alias("base"))
    taken = t.where("status = 'superseded'").select(fx.record_id("project", "type", F.to_timestamp("created_at")).alias("taken")).distinct()
    return rec.unique_ids(made, taken, ["at", "id"]).select("id", "base", "unique_id")


def catalog_sections(spark, sf_dir):
    """The catalog's lines: active and candidate records by project, then those in quarantine."""
    return rec.catalog_lines(memories(spark, sf_dir, ["project", "type", "title", "confidence", "status"]))


def cluster_tags(spark, sf_dir):
    """Clusters with the tag that names their members, and whether an active record's notes end in it already.

    Records whose notes carry such a tag are no members.
    """
    t = memories(spark, sf_dir, ["status", "domain", "title", "trigger_text", "confidence", "notes"]).where("status = 'active'")
    fresh = t.where(~F.coalesce(F.exists("notes", lambda n: n.contains(rec.DERIVED)), F.lit(False)))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("trigger_text", F.lit("")))
    return rec.tagged_clusters(rec.clusters(fresh.select("id", "domain", text.alias("text"), "confidence")), t)


def removed_superseded(spark, sf_dir):
    """The memories without those that another one supersedes or absorbs."""
    t = memories(spark, sf_dir, ["supersedes", "absorbs", "status"])
    gone = t.select(F.explode(F.concat(F.array(F.trim("supersedes")), F.coalesce("absorbs", F.array().cast("array<string>")))).alias("id")).where("id IS NOT NULL")
    return rec.removed(t.select("id", "status"), gone)


def record_files(spark, sf_dir):
    """All memories written as record texts, active ones and quarantine apart, and read back as one store."""
    root = Scratch(spark, "record-files").path
    cols = ["memory_class", "type", "title", "trigger_text", "project", "scope", "domain", "volatile", "confidence", "status", "superseded_by", "supersedes", "promoted_from", "absorbs", "review", "evidence", "provenance", "created_at", "lesson", "notes"]
    t = memories(spark, sf_dir, cols)
    held = F.col("status") == "quarantined"
    for folder, part in (("memories", t.where(~held)), ("quarantine", t.where(held))):
        files.write_texts(part.select(files.record_text().alias("text")), f"{root}/{folder}")
    both = files.read_texts(spark, f"{root}/memories").withColumn("store", F.lit("memories")).unionByName(files.read_texts(spark, f"{root}/quarantine").withColumn("store", F.lit("quarantine")))
    r = files.records(both, ["store"])
    return r.select("store", "id", "type", "title", "trigger_text", F.array_join("domain", ",").alias("domain"), "confidence", "volatile", "superseded_by", F.size("evidence").alias("evidence"), "updated_at", "lesson", F.array_join("notes", "|").alias("notes"), F.array_join("errors", ",").alias("errors"))


def ledger_file(spark, sf_dir):
    """The ledger written as JSON lines and read back."""
    path = Scratch(spark, "ledger-file").path + "/ledger.jsonl"
    files.append_ledger(table(spark, sf_dir, "ledger"), path)
    return files.ledger(spark, path)


def ingested_ledger(spark, sf_dir):
    """The keys of the ledger's rows, each once, as a stream brings them in that is run after either of two arrivals of files."""
    root, keys = Scratch(spark, "ingest").path, ["session_id", "content_hash", "pipeline_version"]
    t = table(spark, sf_dir, "ledger")
    late = F.coalesce(F.col("loaded_at") >= F.to_timestamp(F.lit(EXPORTED)), F.lit(False))
    for arrival in (t.where(~late), t.where(late)):
        arrival.write.mode("append").parquet(f"{root}/landing")
        run_new(spark, f"{root}/landing", t.schema, f"{root}/state", keys, lambda df: df.select(*keys), f"{root}/out")
    return spark.read.option("recursiveFileLookup", True).schema(t.select(*keys).schema).parquet(f"{root}/out")


def silent_stretches(spark, sf_dir):
    """Stretches of each session's messages between silences of six hours."""
    m = in_force(table(spark, sf_dir, "messages"), "id", "time_updated", ["id", "time_updated", "session_id", "time_created"])
    ms = F.when(F.col("time_created") < 100_000_000_000, F.col("time_created") * 1000).otherwise(F.col("time_created"))
    t = silent_sessions(m.where("session_id IS NOT NULL AND time_created IS NOT NULL").select("session_id", F.timestamp_millis(ms).alias("at")))
    return t.select("session_id", F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), "messages")


def candidate_outcomes(spark, sf_dir):
    """How many candidates are dropped for their salience, rejected, held back for a secret, or valid."""
    c = core.candidate_validation(spark, sf_dir)
    s = table(spark, sf_dir, "candidates").select("id", "salience").distinct()
    t = c.join(s, "id")
    outcome = F.when((F.col("salience") < 3) & ~F.isnan("salience"), "below the floor").when(F.col("reasons") != "", "rejected").when(F.col("secrets") != "", "secret").otherwise("valid")
    return t.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: Cases: name, rules to meet, rules that must not be met, most extras, most candidates.
CASES = [
    ("guards", [((), ("guard",), 2), (("pitfall", "root_cause"), ("stale",), 1)], [((), ("no such words",), 1)], None, None),
    ("few extras", [((), ("the",), 1)], [], 150, None),
    ("nothing old", [(("decision",), ("legacy",), 1)], [(("pitfall",), ("returns",), 1)], None, 100000),
]


def case_scores(spark, sf_dir):
    """Each case scored against the candidates of each batch."""
    c = table(spark, sf_dir, "candidates").select("id", "batch_no", "type", "title", "trigger_text", "lesson").distinct()
    return rec.case_scores(c, ["batch_no"], CASES, F.concat_ws(" ", "title", "trigger_text", "lesson"))


def case_pass_rates(spark, sf_dir):
    t = case_scores(spark, sf_dir).groupBy("case").agg(F.count("*").alias("runs"), F.sum(F.col("passed").cast("long")).alias("passes"))
    return t.select("case", "runs", "passes", (F.col("passes") / F.col("runs") >= 0.5).alias("met"))


def retrieval_check(spark, sf_dir):
    """For candidates whose number is divisible by 100 and whose title a memory has: whether such a memory is among the nearest three."""
    c = table(spark, sf_dir, "candidates").where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 100 == 0).select(F.col("id").alias("query_id"), "title").distinct()
    m = memories(spark, sf_dir, ["title", "trigger_text", "lesson"])
    wanted = c.join(m.select("title", F.col("id").alias("expected")), "title")
    found = nearest(c.select("query_id", F.col("title").alias("text")), m.select("id", F.concat_ws(" ", "title", "trigger_text", "lesson").alias("text")), 3)
    t = wanted.join(found.select("query_id", F.col("id").alias("expected"), "rank"), ["query_id", "expected"], "left")
    return t.select("query_id", "expected", F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("within"))


def derived_classes(spark, sf_dir):
    """The memory class that each candidate's type gives."""
    c = table(spark, sf_dir, "candidates").select("id", "type").distinct()
    return c.select("id", F.when(F.col("type") == "workflow", "procedural").otherwise("semantic").alias("memory_class"))


def fence_free(spark, sf_dir):
    """Documents whose text stands in a code fence, and what is left without it; trimmed texts of the rest."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.length(fx.without_fences("text")).alias("n"))


def project_transcripts(spark, sf_dir):
    """Transcripts among the documents that belong to a project and a session, by project."""
    d = table(spark, sf_dir, "documents").where("session_id IS NOT NULL AND project IS NOT NULL")
    return d.groupBy("project").agg(F.count("*").alias("transcripts"), F.countDistinct("session_id").alias("sessions"))


QUERIES = {f.__name__: f for f in (
    root_sessions, session_bundles, export_outcomes, backfill_counts, export_markdown, transcript_triage, transcript_turns, search_domain, search_project, memory_stats, unique_record_ids, catalog_sections, cluster_tags,
    removed_superseded, record_files, ledger_file, ingested_ledger, silent_stretches, candidate_outcomes, case_scores, case_pass_rates, retrieval_check, derived_classes, fence_free, project_transcripts,
)}

# ---- oracle SQL

M, _SES, _MSG, _PRT = core.M, core._SES, core._MSG, core._PRT
_ROOT = "coalesce(trim(parent_id), '') IN ('', 'null')"
_NOW_RENDERED = core.ORACLE["transcript_render"]
_THEN = f"TIMESTAMPTZ '{EXPORTED}+00'"
_THEN_RENDERED = _NOW_RENDERED.replace("FROM messages WHERE id IS NOT NULL", f"FROM messages WHERE id IS NOT NULL AND loaded_at < {_THEN}").replace("FROM parts WHERE id IS NOT NULL", f"FROM parts WHERE id IS NOT NULL AND loaded_at < {_THEN}")
_EXPORT = f"""{_SES}, r AS ({_NOW_RENDERED}), b AS ({_THEN_RENDERED}),
x AS (SELECT s.id AS session_id, s.parent_id, {core._SLUG} AS slug, directory, coalesce(r.user_turns, 0) AS ut, coalesce(r.content_hash, 'sha256:' || left(sha256(''), 16)) AS h, b.content_hash AS old FROM ses s LEFT JOIN r ON r.session_id = s.id LEFT JOIN b ON b.session_id = s.id),
o AS (SELECT *, CASE WHEN NOT ({_ROOT}) THEN 'child session' WHEN slug IN ({', '.join(map(repr, IGNORED))}) OR {' OR '.join(f"contains(directory, '{p}')" for p in IGNORED)} THEN 'ignored project' WHEN ut < {MIN_USER_TURNS} THEN 'too few user turns' END AS reason FROM x),
e AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN old = h THEN 'unchanged' ELSE 'written' END AS outcome FROM o
 UNION ALL SELECT r.session_id, NULL, NULL, NULL, NULL, NULL, NULL, 'not found', 'skipped' FROM r WHERE r.session_id NOT IN (SELECT id FROM ses))"""


def _case_sql(t: str) -> str:
    out = []
    hit = lambda types, words: f"(({'type IN (' + ', '.join(map(repr, types)) + ')' if types else 'true'}) AND " + " AND ".join(f"contains(t, '{w}')" for w in words) + ")"
    for name, expect, forbid, extra, most in CASES:
        met = " + ".join(f"CAST(coalesce(sum(CAST({hit(a, b)} AS INT)), 0) >= {n} AS BIGINT)" for a, b, n in expect)
        bad = " + ".join(f"CAST(coalesce(sum(CAST({hit(a, b)} AS INT)), 0) AS BIGINT)" for a, b, _ in forbid) or "CAST(0 AS BIGINT)"
        more = f"CAST(sum(CASE WHEN {' OR '.join(hit(a, b) for a, b, _ in expect)} THEN 0 ELSE 1 END) AS BIGINT)"
        out.append(f"SELECT batch_no, '{name}' AS \"case\", {met} AS met, CAST({len(expect)} AS BIGINT) AS expected, {bad} AS forbidden, {more} AS extras, count(*) AS total, {'true' if extra is None else f'{more} <= {extra}'} AND {'true' if most is None else f'count(*) <= {most}'} AS gates FROM {t} GROUP BY 1")
    return "SELECT *, (met = expected AND forbidden = 0 AND gates) AS passed FROM (" + " UNION ALL ".join(out) + ")"


_CASES = "c AS (SELECT DISTINCT id, batch_no, type, lower(" + core._TEXT + ") AS t FROM candidates)"
ORACLE = {
    "root_sessions": f"WITH {_SES} SELECT id, row_number() OVER (ORDER BY time_updated, id) - 1 AS place FROM ses WHERE {_ROOT}",
    "session_bundles": f"""WITH {_SES}, {_MSG}, {_PRT}, mm AS (SELECT id, session_id, time_created, row_number() OVER (PARTITION BY session_id ORDER BY time_created, id) - 1 AS message_no FROM msg WHERE json_valid(data) AND json_type({core._JSON}) IN ('OBJECT', 'ARRAY')),
pp AS (SELECT id, message_id, row_number() OVER (PARTITION BY message_id ORDER BY id) - 1 AS part_no FROM prt WHERE message_id IS NOT NULL AND json_valid(data) AND json_type({core._JSON}) IN ('OBJECT', 'ARRAY'))
SELECT s.id AS session_id, mm.id AS message_id, mm.message_no, pp.id AS part_id, coalesce(pp.part_no, -1) AS part_no FROM ses s JOIN mm ON mm.session_id = s.id LEFT JOIN pp ON pp.message_id = mm.id""",
    "export_outcomes": f"WITH {_EXPORT} SELECT session_id, outcome, reason, CASE WHEN outcome <> 'skipped' THEN slug || '/' || session_id || '.md' END AS path FROM e",
    "backfill_counts": f"WITH {_EXPORT} SELECT outcome, count(*) AS sessions FROM e WHERE {_ROOT} AND coalesce(reason, '') <> 'not found' GROUP BY 1",
    "export_markdown": f"""WITH {_SES}, r AS ({_NOW_RENDERED}), mo AS ({core.ORACLE['session_models']}),
f AS (SELECT s.id AS session_id, concat_ws(chr(10), '---', 'session_id: ' || s.id, 'project_dir: ' || to_json(directory), 'title: ' || to_json(title), 'model: ' || to_json(mo.model),
 'time_start: ' || strftime(make_timestamp(time_created * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), 'time_end: ' || strftime(make_timestamp(time_updated * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), 'turns: ' || r.turns,
 'tokens: {{ input: ' || coalesce(tokens_input, 0) || ', output: ' || coalesce(tokens_output, 0) || ' }}', 'content_hash: ' || r.content_hash, 'exported_at: {NOW}', '---', '') || r.body AS md
 FROM ses s JOIN r ON r.session_id = s.id JOIN mo ON mo.id = s.id)
SELECT session_id, CAST(length(md) + len(regexp_extract_all(md, '[\\x{{10000}}-\\x{{10ffff}}]')) AS INT) AS units, sha256(md) AS digest FROM f""".replace("{{ input", "{ input").replace("' }}'", "' }'"),
    "transcript_turns": f"""WITH {core._TURNS} SELECT session_id, turn, id AS message_id, u AS "user", '## T' || turn || ' [' || strftime(make_timestamp(time_created * 1000), '%H:%M') || '] ' || CASE WHEN u THEN 'User' ELSE 'Assistant' END || ' {{#' || id || '}}' || E'\\n\\n' || text || E'\\n' AS block FROM n""",
    "transcript_triage": f"""WITH {_SES}, r AS ({_NOW_RENDERED}), u AS (SELECT session_id, time_updated, CAST(length(body) + len(regexp_extract_all(body, '[\\x{{10000}}-\\x{{10ffff}}]')) AS INT) AS units FROM r JOIN ses ON ses.id = r.session_id)
SELECT session_id, units, CASE WHEN units < 80 THEN 'out' WHEN units < 400 THEN 'out without a model' ELSE 'kept' END AS verdict, row_number() OVER (ORDER BY time_updated, session_id) - 1 AS seq FROM u""",
    "search_domain": "WITH " + core._BM25.replace("AND confidence >= 0.5 ", "AND confidence >= 0 ") + f""", top AS (SELECT * FROM sc ORDER BY score, id LIMIT 40),
d AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM top WHERE list_contains(domain, 'storage'))
SELECT id, title, project, type, confidence, round(rank - confidence - CASE WHEN CAST(updated_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}' - INTERVAL 30 DAY THEN 0.75 ELSE 0 END, 6) AS merit FROM d ORDER BY merit, rank LIMIT 40""",
    "search_project": "WITH " + core._BM25.replace("AND confidence >= 0.5 ", f"AND confidence >= 0.5 AND project = '{PROJECT}' ") + f""", d AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM sc ORDER BY score, id LIMIT 30)
SELECT id, title, project, type, confidence, round(rank - confidence - CASE WHEN CAST(updated_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '{NOW}' - INTERVAL 30 DAY THEN 0.75 ELSE 0 END, 6) AS merit FROM d ORDER BY merit, rank LIMIT 10""",
    "memory_stats": core.ORACLE["counts_by_status_and_type"] + """ UNION ALL SELECT 'processed', NULL, count(DISTINCT (session_id, content_hash, pipeline_version)) FROM ledger WHERE session_id IS NOT NULL AND content_hash IS NOT NULL AND pipeline_version IS NOT NULL
UNION ALL SELECT 'last processed', max(processed_at), 1 FROM ledger WHERE session_id IS NOT NULL AND content_hash IS NOT NULL AND pipeline_version IS NOT NULL UNION ALL SELECT 'quarantine', NULL, count(*) FROM m WHERE status = 'quarantined'""",
    "unique_record_ids": f"""WITH {M}, k AS (SELECT id, created_at, status, concat('mem_', strftime(CAST(created_at AS TIMESTAMP), '%Y%m%d'), '_', left(sha256(project || chr(10) || type), 6)) AS base FROM m),
n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY created_at, id) AS r FROM k), t AS (SELECT DISTINCT base FROM k WHERE status = 'superseded'), s AS (SELECT n.*, r + CASE WHEN t.base IS NULL THEN 0 ELSE 1 END AS slot FROM n LEFT JOIN t ON t.base = n.base)
SELECT id, base, CASE WHEN slot = 1 THEN base ELSE base || '-' || slot END AS unique_id FROM s""",
    "catalog_sections": f"""WITH {M} SELECT 'project ' || project AS section, row_number() OVER (PARTITION BY project ORDER BY type NULLS FIRST, coalesce(confidence, -1) DESC, id) - 1 AS place, id,
 '- [' || coalesce(title, '') || '](memories/' || project || '/' || id || '.md) — ' || type || ', confidence ' || regexp_replace(CAST(confidence AS VARCHAR), '\\.0$', '') || ', ' || status AS line FROM m WHERE status IN ('active', 'candidate') AND project IS NOT NULL
UNION ALL SELECT 'quarantine', row_number() OVER (ORDER BY id) - 1, id, '- ' || id || ': ' || coalesce(title, '') FROM m WHERE status = 'quarantined'""",
    "cluster_tags": core.ORACLE["clusters"].replace("FROM m WHERE status = 'active'", "FROM m WHERE status = 'active' AND len(list_filter(coalesce(notes, []), lambda n: contains(n, 'derived from: '))) = 0").replace(
        "SELECT min(dom) AS domain, max(size) AS size, members, row_number() OVER (ORDER BY max(size) DESC, members) - 1 AS place FROM c GROUP BY members",
        "SELECT members, 'derived from: ' || members AS tag, EXISTS (SELECT 1 FROM (SELECT unnest(notes) AS note FROM m WHERE status = 'active') WHERE contains(note, 'derived from: ') AND substr(note, instr(note, 'derived from: ')) = 'derived from: ' || members) AS known FROM (SELECT DISTINCT members FROM c)"),
    "removed_superseded": f"WITH {M}, g AS (SELECT trim(supersedes) AS id FROM m WHERE supersedes IS NOT NULL UNION SELECT unnest(absorbs) FROM m) SELECT id, status FROM m WHERE id NOT IN (SELECT id FROM g WHERE id IS NOT NULL)",
    "record_files": rf"""WITH {M} SELECT CASE WHEN status = 'quarantined' THEN 'quarantine' ELSE 'memories' END AS store, id, type, title, trigger_text, array_to_string(domain, ',') AS domain, confidence, volatile, superseded_by, CAST(len(evidence) AS INT) AS evidence, updated_at,
 regexp_replace(coalesce(lesson, ''), '^{core._BLANK}+|{core._BLANK}+$', '', 'g') AS lesson, array_to_string(coalesce(notes, []), '|') AS notes, '' AS errors FROM m""",
    "ledger_file": "SELECT session_id, content_hash, pipeline_version, extractor_model, processed_at, n_candidates, n_committed FROM ledger WHERE session_id IS NOT NULL AND content_hash IS NOT NULL AND pipeline_version IS NOT NULL",
    "ingested_ledger": "SELECT DISTINCT session_id, content_hash, pipeline_version FROM ledger WHERE session_id IS NOT NULL AND content_hash IS NOT NULL AND pipeline_version IS NOT NULL",
    "silent_stretches": f"""WITH {_MSG}, t AS (SELECT session_id, CASE WHEN time_created < 100000000000 THEN time_created * 1000 ELSE time_created END AS ms FROM msg WHERE session_id IS NOT NULL AND time_created IS NOT NULL),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) < 21600000 THEN 0 ELSE 1 END AS new FROM t), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT session_id, min(ms) AS started, max(ms) + 21600000 AS ended, count(*) AS messages FROM s GROUP BY session_id, no""",
    "candidate_outcomes": f"""WITH v AS ({core.ORACLE['candidate_validation']}), s AS (SELECT DISTINCT id, salience FROM candidates)
SELECT CASE WHEN salience < 3 THEN 'below the floor' WHEN reasons <> '' THEN 'rejected' WHEN secrets <> '' THEN 'secret' ELSE 'valid' END AS outcome, count(*) AS n FROM v JOIN s USING (id) GROUP BY 1""",
    "case_scores": f"WITH {_CASES} SELECT batch_no, \"case\", met, expected, forbidden, extras, total, passed FROM ({_case_sql('c')})",
    "case_pass_rates": f"WITH {_CASES} SELECT \"case\", count(*) AS runs, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS passes, sum(CAST(passed AS INT)) * 1.0 / count(*) >= 0.5 AS met FROM ({_case_sql('c')}) GROUP BY 1",
    "retrieval_check": core.ORACLE["nearest_memories"].replace("concat_ws(' ', title, trigger_text) AS text FROM candidates", "title AS text FROM candidates").replace("FROM m WHERE status = 'active'", "FROM m").replace(
        "SELECT query_id, id, score, rank FROM", ", e AS (SELECT DISTINCT c.id AS query_id, m.id AS expected FROM candidates c JOIN m ON m.title = c.title WHERE CAST(regexp_extract(c.id, '(\\d+)$', 1) AS BIGINT) % 100 = 0) SELECT e.query_id, e.expected, coalesce(x.rank <= 3, false) AS within FROM e LEFT JOIN (SELECT * FROM").replace(
        "WHERE rank <= 5", "WHERE rank <= 3) x ON x.query_id = e.query_id AND x.id = e.expected"),
    "derived_classes": "SELECT DISTINCT id, CASE WHEN type = 'workflow' THEN 'procedural' ELSE 'semantic' END AS memory_class FROM candidates",
    "fence_free": rf"SELECT doc_id, CAST(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^{core._BLANK}+|{core._BLANK}+$', '', 'g'), '^```(?:json)?\s*', ''), '\s*```\s*$', ''), '^{core._BLANK}+|{core._BLANK}+$', '', 'g')) AS INT) AS n FROM documents WHERE text IS NOT NULL",
    "project_transcripts": "SELECT project, count(*) AS transcripts, count(DISTINCT session_id) AS sessions FROM documents WHERE session_id IS NOT NULL AND project IS NOT NULL GROUP BY 1",
}
