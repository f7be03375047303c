"""Queries over records, candidates, the ledger and sessions, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import text as fx
from sessionloom.operators import records as rec
from sessionloom.operators import search, transcripts
from sessionloom.operators.prefix_join import nearest, similar_classes
from sessionloom.runtime import in_force, table

QUERY = "stale guard watermark"
NOW = "2026-06-15T00:00:00Z"
#: Every row of the memories in force, without the columns that only say when a row came.
COLUMNS = ["id", "updated_at", "memory_class", "type", "title", "trigger_text", "project", "scope", "domain", "volatile", "confidence", "status", "superseded_by", "supersedes", "promoted_from", "review", "evidence", "created_at", "lesson"]


def memories(spark: SparkSession, sf_dir: str, columns: list[str] = COLUMNS) -> DataFrame:
    return in_force(table(spark, sf_dir, "memories"), "id", "updated_at", list(dict.fromkeys(["id", "updated_at", *columns])))


_SEARCHED = ["type", "title", "trigger_text", "project", "domain", "confidence", "status", "lesson"]


def search_bm25(spark, sf_dir):
    t = search.bm25(memories(spark, sf_dir, _SEARCHED), QUERY, status="active", min_confidence=0.5)
    return t.select("id", F.round("score", 6).alias("score"))


def search_memory(spark, sf_dir):
    t = search.search(memories(spark, sf_dir, _SEARCHED), QUERY, NOW)
    return t.select("id", "title", "trigger_text", "project", "type", F.array_join("domain", ",").alias("domain"), "confidence", "updated_at", F.round("merit", 6).alias("merit"))


def search_like(spark, sf_dir):
    return search.like(memories(spark, sf_dir, _SEARCHED), "vm io", 25, status="active").select("id", "confidence", "score")


def search_weighted_scan(spark, sf_dir):
    return search.weighted_scan(memories(spark, sf_dir, _SEARCHED), QUERY, 50, min_confidence=0.5).select("id", "confidence", "score")


def counts_by_status_and_type(spark, sf_dir):
    t = memories(spark, sf_dir, ["status", "type"])
    g = t.groupingSets([[F.col("status")], [F.col("type")]], "status", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "status").otherwise("type").alias("facet"), F.coalesce("status", "type").alias("value"), "n")


def domain_counts(spark, sf_dir):
    t = memories(spark, sf_dir, ["status", "domain"]).where("status = 'active'")
    return t.select(F.explode("domain").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def project_counts(spark, sf_dir):
    t = memories(spark, sf_dir, ["status", "project", "confidence"]).where("status = 'active'")
    return t.groupBy("project").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def catalog_order(spark, sf_dir):
    return rec.catalog(memories(spark, sf_dir, ["project", "type", "confidence"]))


def record_confidence(spark, sf_dir):
    t = memories(spark, sf_dir, ["evidence", "review", "status"])
    sessions = F.size(F.array_distinct(F.transform("evidence", lambda e: e["session"])))
    return t.select("id", sessions.alias("sessions"), fx.confidence(sessions, F.col("review") == "human_approved", F.col("status") == "superseded").alias("confidence"))


def record_ids(spark, sf_dir):
    t = memories(spark, sf_dir, ["project", "title", "created_at"])
    return t.select("id", fx.record_id("project", "title", F.to_timestamp("created_at")).alias("made_id"), fx.short_hash("title").alias("title_hash"))


def linked_records(spark, sf_dir):
    """Each pointer of a record with the state of the record it names, one hop; ``missing`` if there is none."""
    t = memories(spark, sf_dir, ["superseded_by", "supersedes", "promoted_from", "absorbs", "status", "project"])
    single = F.array(*[F.struct(F.lit(c).alias("link"), F.col(c).alias("target")) for c in ("superseded_by", "supersedes", "promoted_from")])
    several = F.transform(F.coalesce("absorbs", F.array().cast("array<string>")), lambda x: F.struct(F.lit("absorbs").alias("link"), x.alias("target")))
    links = t.select("id", F.explode(F.concat(single, several)).alias("l")).select("id", "l.*")
    links = links.where(F.trim("target").isNotNull() & (F.trim("target") != "") & (F.lower(F.trim("target")) != "null")).withColumn("target", F.trim("target"))
    there = t.select(F.col("id").alias("target"), F.col("status").alias("target_status"), F.col("project").alias("target_project"))
    return links.join(there, "target", "left").select("id", "link", "target", F.coalesce("target_status", F.lit("missing")).alias("target_status"), "target_project")


def evidence_union(spark, sf_dir):
    return rec.evidence_union(memories(spark, sf_dir, ["evidence"]))


def cross_project_records(spark, sf_dir):
    """Active project records whose evidence comes from sessions of two or more projects, without those already promoted."""
    t = memories(spark, sf_dir, ["evidence", "status", "scope", "promoted_from"])
    s = in_force(table(spark, sf_dir, "sessions"), "id", "time_updated", ["id", "time_updated", "directory"]).select(F.col("id").alias("session"), fx.project_slug("directory").alias("slug"))
    seen = t.where("status = 'active' AND scope = 'project'").select("id", F.explode("evidence").alias("e")).select("id", F.col("e.session").alias("session")).distinct()
    n = seen.join(s, "session").groupBy("id").agg(F.countDistinct("slug").alias("projects")).where("projects >= 2")
    taken = t.where("status <> 'archived'").select(F.trim("promoted_from").alias("id")).where("id <> ''").distinct()
    return n.join(taken, "id", "left_anti")


def title_classes(spark, sf_dir):
    """Of every memory: the least id with its title's tokens, in its type, and how many alike other titles there are."""
    t = memories(spark, sf_dir, ["type", "title"]).select("id", F.col("type").alias("block"), F.col("title").alias("text"))
    membership, links = similar_classes(t, 0.6)
    n = links.select("block", F.explode(F.array("a", "b")).alias("class_id")).groupBy("block", "class_id").agg(F.count("*").alias("links"))
    return membership.join(n, ["block", "class_id"], "left").select("id", F.col("block").alias("type"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def title_links(spark, sf_dir):
    t = memories(spark, sf_dir, ["type", "title"]).select("id", F.col("type").alias("block"), F.col("title").alias("text"))
    return similar_classes(t, 0.6)[1].select(F.col("block").alias("type"), "a", "b", F.round("similarity", 6).alias("similarity"))


def clusters(spark, sf_dir):
    t = memories(spark, sf_dir, ["status", "domain", "title", "trigger_text", "confidence"]).where("status = 'active'")
    return rec.clusters(t.select("id", "domain", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("trigger_text", F.lit(""))).alias("text"), "confidence"))


def candidate_validation(spark, sf_dir):
    c = table(spark, sf_dir, "candidates")
    known = transcripts.turns(table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts"))  # only rendered messages have an anchor
    cols = ["id", "session_id", "type", "title", "trigger_text", "lesson", "domain", "evidence", "salience", "volatile"]
    return rec.validated(c.select(*cols).distinct(), known).select("id", F.array_join("reasons", ";").alias("reasons"), F.array_join("secrets", ",").alias("secrets"))


def pool_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "candidates")
    return rec.deduplicated(c.withColumn("pos", F.shiftleft("batch_no", 32) + F.col("pos")))


def salience_consensus(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select("id", "session_id", "salience").distinct()
    return rec.consensus(c, "session_id", "salience")


def nearest_memories(spark, sf_dir):
    """The five nearest active memories of every candidate whose number is divisible by 100."""
    c = table(spark, sf_dir, "candidates").where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 100 == 0).select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "trigger_text").alias("text")).distinct()
    m = memories(spark, sf_dir, ["status", "title", "trigger_text", "lesson"]).where("status = 'active'")
    return nearest(c, m.select("id", F.concat_ws(" ", "title", "trigger_text", "lesson").alias("text")), 5)


def secret_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(fx.secret_labels("text")).alias("label"))
    return d


def anchor_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(fx.anchors("text")).alias("anchors"), fx.words(F.coalesce("text", F.lit(""))).alias("words"))
    return d.where("anchors > 0")


def ledger_latest(spark, sf_dir):
    t = table(spark, sf_dir, "ledger").where("session_id IS NOT NULL")
    g = t.groupBy("session_id", "content_hash", "pipeline_version").agg(F.max(F.struct("processed_at", "loaded_at", "extractor_model", "n_candidates", "n_committed")).alias("m"))
    return g.select("session_id", "content_hash", "pipeline_version", "m.processed_at", "m.n_candidates", "m.n_committed")


def ledger_stats(spark, sf_dir):
    t = table(spark, sf_dir, "ledger")
    return t.groupBy("pipeline_version").agg(F.countDistinct("session_id", "content_hash").alias("runs"), F.countDistinct("session_id").alias("sessions"), F.max("processed_at").alias("last"))


def _still_sessions(spark, sf_dir):
    """Root sessions that have been still for six hours at the fixed clock."""
    s = in_force(table(spark, sf_dir, "sessions"), "id", "time_updated", ["id", "time_updated", "parent_id", "directory"])
    still = F.timestamp_millis("time_updated") <= F.to_timestamp(F.lit(NOW)) - F.expr("INTERVAL 6 HOURS")
    return s.where(F.coalesce(F.trim("parent_id"), F.lit("")).isin("", "null") & still).withColumnRenamed("id", "session_id")


def unprocessed_sessions(spark, sf_dir):
    """Still root sessions that the ledger of version 1 lacks in any state; ``unprocessed_versions`` has the changed ones too."""
    done = table(spark, sf_dir, "ledger").where("pipeline_version = '1'")
    return rec.unprocessed(_still_sessions(spark, sf_dir), done, ["session_id"]).select("session_id", fx.project_slug("directory").alias("project"), fx.iso_ms("time_updated").alias("time_end"))


def unprocessed_versions(spark, sf_dir):
    """Still root sessions whose present rendering the ledger of version 1 lacks; one without turns has the hash of an empty body."""
    r = transcript_render(spark, sf_dir).select("session_id", "content_hash")
    s = _still_sessions(spark, sf_dir).join(r, "session_id", "left").withColumn("content_hash", F.coalesce("content_hash", fx.short_hash(F.lit(""))))
    done = table(spark, sf_dir, "ledger").where("pipeline_version = '1'")
    return rec.unprocessed(s, done, ["session_id", "content_hash"]).select("session_id", "content_hash", fx.project_slug("directory").alias("project"), fx.iso_ms("time_updated").alias("time_end"))


def session_models(spark, sf_dir):
    return transcripts.session_models(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "messages"))


def transcript_render(spark, sf_dir):
    return transcripts.rendered(table(spark, sf_dir, "messages"), table(spark, sf_dir, "parts"))


def part_type_counts(spark, sf_dir):
    p = in_force(table(spark, sf_dir, "parts"), "id", "time_updated", ["id", "time_updated", "data"]).where(transcripts.readable("data"))
    return p.select(F.coalesce(F.get_json_object("data", "$.type"), F.lit("none")).alias("kind"), F.length("data").alias("size")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("characters"))


_CUT = "2026-06-01 00:00:00"


def upsert_merge(spark, sf_dir):
    """Memory rows that came since the cut upserted into those of before; created_at is kept from the older row."""
    t = table(spark, sf_dir, "memories").select("id", "updated_at", "status", "superseded_by", "created_at", "loaded_at")
    late = F.col("loaded_at") >= F.to_timestamp(F.lit(_CUT))
    base = in_force(t.where(~late), "id", "updated_at", ["id", "updated_at", "status", "superseded_by", "created_at"])
    return rec.merged_by_key(base, t.where(late), "id", ["updated_at"], ["created_at"])


RULES = [("guards", (), ("guard",), 1), ("stale_pitfalls", ("pitfall", "root_cause"), ("stale", "returns"), 1), ("legacy_decisions", ("decision",), ("legacy",), 5), ("none", (), ("no such words here",), 1)]


def rule_scorecard(spark, sf_dir):
    c = table(spark, sf_dir, "candidates").select("id", "type", "title", "trigger_text", "lesson").distinct()
    return rec.rule_hits(c, RULES, F.concat_ws(" ", "title", "trigger_text", "lesson"))


def access_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.groupBy("user_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


QUERIES = {f.__name__: f for f in (
    search_bm25, search_memory, search_like, search_weighted_scan, counts_by_status_and_type, domain_counts, project_counts, catalog_order, record_confidence, record_ids, linked_records,
    evidence_union, cross_project_records, title_classes, title_links, clusters, candidate_validation, pool_dedup, salience_consensus, nearest_memories, secret_scan, anchor_counts,
    ledger_latest, ledger_stats, unprocessed_sessions, unprocessed_versions, session_models, transcript_render, part_type_counts, upsert_merge, rule_scorecard, access_stats,
)}

# ---- oracle SQL

M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM memories WHERE id IS NOT NULL) WHERE rn = 1)"
_FIELDS = ["lower(coalesce(title, ''))", "lower(coalesce(trigger_text, ''))", "lower(coalesce(lesson, ''))", "lower(coalesce(array_to_string(domain, ' '), ''))"]
_WORDS = QUERY.split()


def _apart(f: str, w: str) -> str:
    return f"((length({f}) - length(replace({f}, '{w}', ''))) // {len(w)})"


_D = " + ".join(f"greatest(length({f}) - 2, 0)" for f in _FIELDS)
_F = ", ".join(f"CAST({' + '.join(_apart(f, w) for f in _FIELDS)} AS DOUBLE) AS f{i}" for i, w in enumerate(_WORDS))
_IDF = [f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)" for i in range(len(_WORDS))]
_BM25 = f"""{M}, tf AS (SELECT m.*, CAST({_D} AS DOUBLE) AS d, {_F} FROM m),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(d) AS av, {', '.join(f'CAST(sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}' for i in range(len(_WORDS)))} FROM tf),
sc AS (SELECT tf.*, -({' + '.join(f'{_IDF[i]} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / av))' for i in range(len(_WORDS)))}) AS score
 FROM tf, st WHERE status = 'active' AND confidence >= 0.5 AND ({' OR '.join(f'f{i} > 0' for i in range(len(_WORDS)))}))"""


def _like(words: list[str]) -> str:
    return " OR ".join(f"contains({f}, '{w}')" for f in _FIELDS for w in words)


_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))"
_SIM = "(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN CASE WHEN trim({ra}) = trim({rb}) THEN 1 ELSE 0 END WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) * 1.0 / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"
_CLASSES = f"""{M}, k AS (SELECT id, type AS block, coalesce(title, '') AS text, list_sort({_TOK.format('title')}) AS s FROM m WHERE type IS NOT NULL),
c AS (SELECT block, s, CASE WHEN len(s) = 0 THEN trim(text) ELSE '' END AS raw, min(id) AS class_id FROM k GROUP BY ALL),
l AS (SELECT x.block, x.class_id AS a, y.class_id AS b, len(list_intersect(x.s, y.s)) * 1.0 / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS similarity
 FROM c x JOIN c y ON x.block = y.block AND x.class_id < y.class_id AND len(x.s) > 0 AND len(y.s) > 0 AND len(list_intersect(x.s, y.s)) >= 0.6 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))))"""
_MSG = "msg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, loaded_at DESC) AS rn FROM messages WHERE id IS NOT NULL) WHERE rn = 1)"
_SES = "ses AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, loaded_at DESC) AS rn FROM sessions WHERE id IS NOT NULL) WHERE rn = 1)"
_PRT = "prt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, loaded_at DESC) AS rn FROM parts WHERE id IS NOT NULL) WHERE rn = 1)"
_JSON = "CASE WHEN json_valid(data) THEN data ELSE 'null' END"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(directory, '/+$', ''), '([^/]*)$', 1)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"
_TEXT = "concat_ws(' ', title, trigger_text, lesson)"
_BLANK = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_NOISY = r"""(length(t) >= 32 AND NOT contains(t, '://') AND NOT regexp_matches(t, '^(?:sha\d+:)?[0-9a-fA-F]{16,}$') AND NOT regexp_matches(t, '^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')
 AND ((CAST(regexp_matches(t, '[a-z]') AS INT) + CAST(regexp_matches(t, '[A-Z]') AS INT) + CAST(regexp_matches(t, '[0-9]') AS INT) + CAST(regexp_matches(t, '[^A-Za-z0-9]') AS INT) >= 3 AND regexp_matches(t, '[^A-Za-z0-9:\-._/]'))
  OR (length(t) >= 48 AND regexp_matches(t, '^[A-Za-z0-9]+$') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]'))))"""
_SECRETS = r"""list_filter([CASE WHEN regexp_matches({0}, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'pem-private-key' END, CASE WHEN regexp_matches({0}, 'AKIA[0-9A-Z]{{16}}') THEN 'aws-access-key' END,
 CASE WHEN regexp_matches({0}, '\b(?:sk|ghp|gho|xox[bpas])[-_][A-Za-z0-9]{{16,}}\b') THEN 'token-prefix' END, CASE WHEN len(list_filter(regexp_split_to_array({0}, '[\t\n\x0b\f\r \x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+'), lambda t: {1})) > 0 THEN 'high-entropy-token' END], lambda x: x IS NOT NULL)"""

_TURNS = f"""{_MSG}, {_PRT}, p AS (SELECT id, message_id, json_extract_string(j, '$.type') AS kind, trim(json_extract_string(j, '$.text'), E' \\t\\n\\r') AS text, coalesce(json_extract_string(j, '$.tool'), 'unknown') AS tool, coalesce(CAST(json_extract(j, '$.state.input') AS VARCHAR), '') AS given, coalesce(json_extract_string(j, '$.state.status'), '?') AS status FROM (SELECT id, message_id, {_JSON} AS j FROM prt)),
b AS (SELECT id, message_id, CASE WHEN kind = 'text' AND text <> '' THEN text WHEN kind = 'tool' THEN '> 🔧 ' || tool || ' ' || CASE WHEN length(given) > 160 THEN left(given, 160) || '…' ELSE given END || ' → ' || status END AS body FROM p),
t AS (SELECT message_id, string_agg(body, E'\\n\\n' ORDER BY id) AS text FROM b WHERE body IS NOT NULL GROUP BY 1),
n AS (SELECT session_id, msg.id, coalesce(json_extract_string({_JSON}, '$.role'), '') = 'user' AS u, row_number() OVER (PARTITION BY session_id ORDER BY time_created, msg.id) AS turn, time_created, t.text FROM msg JOIN t ON t.message_id = msg.id WHERE session_id IS NOT NULL AND json_valid(data) AND json_type({_JSON}) IN ('OBJECT', 'ARRAY'))"""

ORACLE = {
    "search_bm25": f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM sc",
    "search_memory": f"""WITH {_BM25}, top AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM sc ORDER BY score, id LIMIT 30)
SELECT id, title, trigger_text, project, type, array_to_string(domain, ',') AS domain, confidence, updated_at,
 round(rank - confidence - CASE WHEN CAST(updated_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2026-06-15 00:00:00+00' - INTERVAL 30 DAY THEN 0.75 ELSE 0 END, 6) AS merit FROM top ORDER BY merit, rank LIMIT 10""",
    "search_like": f"WITH {M} SELECT id, confidence, CAST(0 AS DOUBLE) AS score FROM m WHERE status = 'active' AND ({_like(['vm', 'io'])}) ORDER BY confidence DESC, id LIMIT 25",
    "search_weighted_scan": f"""WITH {M}, s AS (SELECT id, confidence, -CAST({' + '.join(f'{w} * {_apart(f, t)}' for f, w in zip(_FIELDS, (3, 2, 1, 2), strict=True) for t in _WORDS)} AS DOUBLE) AS score FROM m WHERE confidence >= 0.5)
SELECT id, confidence, score FROM s WHERE score < 0 ORDER BY score, confidence DESC, id LIMIT 50""",
    "counts_by_status_and_type": f"WITH {M} SELECT 'status' AS facet, status AS value, count(*) AS n FROM m GROUP BY status UNION ALL SELECT 'type', type, count(*) FROM m GROUP BY type",
    "domain_counts": f"WITH {M} SELECT domain, count(*) AS n FROM (SELECT unnest(domain) AS domain FROM m WHERE status = 'active') GROUP BY domain",
    "project_counts": f"WITH {M} SELECT project, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM m WHERE status = 'active' GROUP BY project",
    "catalog_order": f"WITH {M} SELECT id, project, type, row_number() OVER (PARTITION BY project ORDER BY type NULLS FIRST, coalesce(confidence, -1) DESC, id) - 1 AS place FROM m",
    "record_confidence": f"""WITH {M}, c AS (SELECT id, len(list_distinct(list_transform(evidence, lambda e: e.session))) AS sessions, review, status FROM m)
SELECT id, CAST(sessions AS INT) AS sessions, floor(least(CAST(0.95 AS DOUBLE), greatest(CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.15 AS DOUBLE) * (sessions - 1) + CASE WHEN review = 'human_approved' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END - CASE WHEN status = 'superseded' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) * 100 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS confidence FROM c""",
    "record_ids": f"WITH {M} SELECT id, concat('mem_', strftime(CAST(created_at AS TIMESTAMP), '%Y%m%d'), '_', left(sha256(project || chr(10) || title), 6)) AS made_id, 'sha256:' || left(sha256(title), 16) AS title_hash FROM m",
    "linked_records": f"""WITH {M}, l AS (SELECT id, 'superseded_by' AS link, trim(superseded_by) AS target FROM m UNION ALL SELECT id, 'supersedes', trim(supersedes) FROM m UNION ALL SELECT id, 'promoted_from', trim(promoted_from) FROM m UNION ALL SELECT id, 'absorbs', trim(unnest(absorbs)) FROM m)
SELECT l.id, link, target, coalesce(m.status, 'missing') AS target_status, m.project AS target_project FROM l LEFT JOIN m ON m.id = l.target WHERE target <> '' AND lower(target) <> 'null'""",
    "evidence_union": f"""WITH {M}, e AS (SELECT id, i AS k, evidence[i].session AS session, evidence[i].anchors AS anchors FROM (SELECT id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM m)),
a AS (SELECT id, session, anchor, min(row(k, j)) AS first FROM (SELECT id, session, k, j, anchors[j] AS anchor FROM (SELECT *, unnest(range(1, len(anchors) + 1)) AS j FROM e)) GROUP BY ALL),
g AS (SELECT id, session, string_agg(anchor, ',' ORDER BY first) AS anchors FROM a GROUP BY 1, 2),
n AS (SELECT id, session, count(*) AS observations FROM e WHERE session IS NOT NULL GROUP BY 1, 2)
SELECT n.id, n.session, coalesce(g.anchors, '') AS anchors, observations FROM n LEFT JOIN g ON g.id = n.id AND g.session = n.session""",
    "cross_project_records": f"""WITH {M}, {_SES}, e AS (SELECT DISTINCT id, s.session FROM (SELECT id, unnest(evidence) AS s FROM m WHERE status = 'active' AND scope = 'project'))
SELECT e.id, count(DISTINCT {_SLUG}) AS projects FROM e JOIN ses ON ses.id = e.session WHERE e.id NOT IN (SELECT trim(promoted_from) FROM m WHERE status <> 'archived' AND trim(promoted_from) <> '') GROUP BY 1 HAVING count(DISTINCT {_SLUG}) >= 2""",
    "title_classes": f"""WITH {_CLASSES} SELECT k.id, k.block AS type, c.class_id, count(l.a) AS links FROM k JOIN c ON c.block = k.block AND c.s = k.s AND c.raw = CASE WHEN len(k.s) = 0 THEN trim(k.text) ELSE '' END
LEFT JOIN l ON l.block = c.block AND (l.a = c.class_id OR l.b = c.class_id) GROUP BY ALL""",
    "title_links": f"WITH {_CLASSES} SELECT block AS type, a, b, round(similarity, 6) AS similarity FROM l",
    "clusters": f"""WITH RECURSIVE {M}, k AS (SELECT DISTINCT id, unnest(domain) AS dom, confidence, {_TOK.format("concat_ws(' ', coalesce(title, ''), coalesce(trigger_text, ''))")} AS s, concat_ws(' ', coalesce(title, ''), coalesce(trigger_text, '')) AS text FROM m WHERE status = 'active'),
e AS (SELECT x.dom, x.id AS a, y.id AS b FROM k x JOIN k y ON x.dom = y.dom AND x.id <> y.id AND {_SIM.format(a='x.s', b='y.s', ra='x.text', rb='y.text')} >= 0.35),
r AS (SELECT dom, id, id AS other FROM k UNION SELECT r.dom, r.id, e.b FROM r JOIN e ON e.dom = r.dom AND e.a = r.other),
g AS (SELECT dom, id, min(other) AS root FROM r GROUP BY 1, 2),
q AS (SELECT g.*, row_number() OVER (PARTITION BY g.dom, root ORDER BY k.confidence DESC NULLS LAST, g.id) AS place, count(*) OVER (PARTITION BY g.dom, root) AS n FROM g JOIN k ON k.dom = g.dom AND k.id = g.id),
c AS (SELECT dom, root, string_agg(id, ',' ORDER BY id) AS members, count(*) AS size FROM q WHERE place <= 12 AND n >= 2 GROUP BY 1, 2)
SELECT min(dom) AS domain, max(size) AS size, members, row_number() OVER (ORDER BY max(size) DESC, members) - 1 AS place FROM c GROUP BY members""",
    "candidate_validation": rf"""WITH {_TURNS}, c AS (SELECT DISTINCT id, session_id, type, title, trigger_text, lesson, domain, evidence, salience, volatile FROM candidates),
u AS (SELECT DISTINCT id FROM (SELECT id, session_id, regexp_replace(e.message_id, '^#', '') AS mid FROM (SELECT id, session_id, unnest(evidence) AS e FROM c)) x WHERE mid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.session_id = x.session_id AND n.id = x.mid))
SELECT id, array_to_string(list_filter([
 CASE WHEN coalesce(type IN ('decision', 'root_cause', 'pitfall', 'know_how', 'convention', 'workflow'), false) THEN NULL ELSE 'type' END,
 CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(trigger_text), '') = '' THEN 'trigger_text' END, CASE WHEN coalesce(trim(lesson), '') = '' THEN 'lesson' END,
 CASE WHEN len(regexp_split_to_array(regexp_replace(lesson, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+')) > 80 THEN 'lesson exceeds 80 words' END,
 CASE WHEN coalesce(len(domain), 0) = 0 OR len(list_filter(domain, lambda d: d IS NULL OR d = '')) > 0 THEN 'domain' END,
 CASE WHEN coalesce(len(evidence), 0) = 0 THEN 'evidence' END, CASE WHEN len(list_filter(evidence, lambda e: e.message_id IS NULL)) > 0 THEN 'evidence without message' END,
 CASE WHEN id IN (SELECT id FROM u) THEN 'unknown message' END, CASE WHEN salience IS NULL THEN 'salience' END, CASE WHEN volatile IS NULL THEN 'volatile' END], lambda x: x IS NOT NULL), ';') AS reasons,
 array_to_string({_SECRETS.format(_TEXT, _NOISY)}, ',') AS secrets FROM c""",
    "salience_consensus": """SELECT session_id, quantile_disc(CASE WHEN salience BETWEEN 0 AND 10 THEN salience END, 0.5) AS median, count(CASE WHEN salience BETWEEN 0 AND 10 THEN 1 END) AS voted, count(*) AS panel
FROM (SELECT DISTINCT id, session_id, salience FROM candidates) WHERE session_id IS NOT NULL GROUP BY 1""",
    "nearest_memories": rf"""WITH {M}, q AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS word FROM (SELECT DISTINCT id AS query_id, concat_ws(' ', title, trigger_text) AS text FROM candidates WHERE CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT) % 100 = 0)),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower({_TEXT}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS word FROM m WHERE status = 'active'),
tf AS (SELECT id, word, count(*) AS f FROM w GROUP BY 1, 2), ln_ AS (SELECT id, sum(f) AS d FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(d) AS av FROM ln_), df AS (SELECT word, count(*) AS nw FROM tf GROUP BY 1),
sc AS (SELECT query_id, tf.id, round(sum(ln(1 + (n - nw + 0.5) / (nw + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / av))), 6) AS score FROM q JOIN df USING (word) JOIN tf USING (word) JOIN ln_ USING (id), st GROUP BY 1, 2)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5""",
    "secret_scan": f"SELECT doc_id, unnest({_SECRETS.format('text', _NOISY)}) AS label FROM documents WHERE text IS NOT NULL",
    "anchor_counts": r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '\{#([^}]+)\}', 1))) AS INT) AS anchors, CAST(len(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+')) AS INT) AS words FROM documents WHERE len(regexp_extract_all(text, '\{#([^}]+)\}', 1)) > 0",
    "ledger_latest": """SELECT session_id, content_hash, pipeline_version, processed_at, n_candidates, n_committed FROM (SELECT *, row_number() OVER (PARTITION BY session_id, content_hash, pipeline_version
 ORDER BY processed_at DESC NULLS LAST, loaded_at DESC NULLS LAST, extractor_model DESC NULLS LAST, n_candidates DESC NULLS LAST, n_committed DESC NULLS LAST) AS rn FROM ledger WHERE session_id IS NOT NULL) WHERE rn = 1""",
    "ledger_stats": "SELECT pipeline_version, count(DISTINCT (session_id, content_hash)) AS runs, count(DISTINCT session_id) AS sessions, max(processed_at) AS last FROM ledger GROUP BY 1",
    "unprocessed_sessions": f"""WITH {_SES} SELECT id AS session_id, {_SLUG} AS project, strftime(make_timestamp(time_updated * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS time_end FROM ses
WHERE coalesce(trim(parent_id), '') IN ('', 'null') AND time_updated <= 1781481600000 - 21600000 AND id NOT IN (SELECT session_id FROM ledger WHERE pipeline_version = '1' AND session_id IS NOT NULL)""",
    "session_models": f"""WITH {_SES}, {_MSG}, l AS (SELECT session_id, arg_max(mid, (time_created, id)) AS last FROM (SELECT id, session_id, time_created, nullif(json_extract_string({_JSON}, '$.modelID'), '') AS mid FROM msg) WHERE mid IS NOT NULL GROUP BY 1),
s AS (SELECT id, nullif(json_extract_string(j, '$.id'), '') AS own, nullif(json_extract_string(j, '$.providerID'), '') AS provider FROM (SELECT id, CASE WHEN json_valid(model) THEN model ELSE 'null' END AS j FROM ses))
SELECT s.id, coalesce(provider || '/' || own, own, l.last, 'unknown') AS model FROM s LEFT JOIN l ON l.session_id = s.id""",
    "transcript_render": f"""WITH {_TURNS},
r AS (SELECT session_id, count(*) AS turns, CAST(sum(CASE WHEN u THEN 1 ELSE 0 END) AS BIGINT) AS user_turns, string_agg('## T' || turn || ' [' || strftime(make_timestamp(time_created * 1000), '%H:%M') || '] ' || CASE WHEN u THEN 'User' ELSE 'Assistant' END || ' {{#' || id || '}}' || E'\\n\\n' || text || E'\\n', E'\\n' ORDER BY turn) AS body FROM n GROUP BY 1)
SELECT session_id, turns, user_turns, body, 'sha256:' || left(sha256(body), 16) AS content_hash FROM r""",
    "part_type_counts": f"WITH {_PRT} SELECT coalesce(json_extract_string(data, '$.type'), 'none') AS kind, count(*) AS n, CAST(sum(length(data)) AS BIGINT) AS characters FROM prt WHERE json_valid(data) AND json_type({_JSON}) IN ('OBJECT', 'ARRAY') GROUP BY 1",
    "upsert_merge": f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM memories WHERE id IS NOT NULL AND loaded_at < TIMESTAMPTZ '{_CUT}+00') WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM memories WHERE id IS NOT NULL AND loaded_at >= TIMESTAMPTZ '{_CUT}+00') WHERE rn = 1)
SELECT coalesce(n.id, b.id) AS id, coalesce(n.updated_at, b.updated_at) AS updated_at, CASE WHEN n.id IS NULL THEN b.status ELSE n.status END AS status, CASE WHEN n.id IS NULL THEN b.superseded_by ELSE n.superseded_by END AS superseded_by,
 CASE WHEN b.id IS NULL THEN n.created_at ELSE b.created_at END AS created_at, CASE WHEN n.id IS NULL THEN 'keep' WHEN b.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM b FULL JOIN n ON n.id = b.id""",
    "rule_scorecard": "WITH c AS (SELECT DISTINCT id, type, lower(" + _TEXT + ") AS t FROM candidates) " + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) AS hits, count(*) >= {least} AS met FROM c WHERE {'type IN (' + ', '.join(repr(x) for x in types) + ')' if types else 'true'} AND " + " AND ".join(f"contains(t, '{k}')" for k in kw) for n, types, kw, least in RULES),
    "access_stats": "SELECT user_id, count(*) AS access_count, max(ts) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY 1",
}
# One candidate after another in each session and type, the open pool carried along as a list.
_LIKE = "m.trigger_text = c.trigger_text OR (CASE WHEN len(m.tokens) = 0 AND len(c.tokens) = 0 THEN m.raw = c.raw ELSE len(list_intersect(m.tokens, c.tokens)) >= 0.6 * (len(m.tokens) + len(c.tokens) - len(list_intersect(m.tokens, c.tokens))) END)"
_LONGER = ", ".join(f"{x} := CASE WHEN c.size > m.size THEN c.{x} ELSE m.{x} END" for x in ("id", "title", "trigger_text", "lesson", "size", "tokens", "raw"))
_MERGED = f"struct_pack({_LONGER}, salience := greatest(m.salience, c.salience), volatile := m.volatile OR c.volatile, domain := m.domain || list_filter(c.domain, lambda x: NOT list_contains(m.domain, x)), cited := m.cited || list_filter(c.cited, lambda x: NOT list_contains(m.cited, x)), secrets := list_sort(list_distinct(m.secrets || c.secrets)), merged := m.merged + 1)"
_MEMBER = "struct_pack(id := c.id, title := c.title, trigger_text := c.trigger_text, lesson := c.lesson, size := c.size, tokens := c.tokens, raw := c.raw, salience := c.salience, volatile := c.volatile, domain := c.domain, cited := c.cited, secrets := c.secrets, merged := CAST(0 AS BIGINT))"
_ONCE = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)"
ORACLE["pool_dedup"] = rf"""WITH RECURSIVE c0 AS (SELECT id, coalesce(session_id, '') AS session_id, coalesce(type, '') AS type, batch_no * 4294967296 + pos AS seq, coalesce(title, '') AS title, coalesce(trigger_text, '') AS trigger_text, coalesce(lesson, '') AS lesson, coalesce(salience, 0) AS salience, coalesce(volatile, false) AS volatile, coalesce(domain, []) AS domain,
 coalesce(list_transform(evidence, lambda e: regexp_replace(e.message_id, '^#', '')), []) AS cited FROM candidates WHERE id IS NOT NULL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY id, session_id, type ORDER BY seq, title, trigger_text, lesson, salience, volatile) AS again FROM c0),
c2 AS (SELECT session_id, type, id, title, trigger_text, lesson, length(lesson) + len(regexp_extract_all(lesson, '[\x{{10000}}-\x{{10ffff}}]')) AS size, {_TOK.format('title')} AS tokens, trim(title) AS raw, salience, volatile, {_ONCE.format('domain')} AS domain, {_ONCE.format('cited')} AS cited,
 {_SECRETS.format("(title || ' ' || trigger_text || ' ' || lesson)", _NOISY)} AS secrets, row_number() OVER (PARTITION BY session_id, type ORDER BY seq, id) AS n FROM c1 WHERE again = 1),
r AS (SELECT session_id, type, n, [{_MEMBER}] AS pool FROM c2 c WHERE n = 1
 UNION ALL SELECT session_id, type, n, CASE WHEN hit IS NULL THEN list_append(pool, member) ELSE list_transform(pool, lambda m, i: CASE WHEN i = hit THEN {_MERGED} ELSE m END) END AS pool
 FROM (SELECT r.session_id, r.type, c.n, r.pool, {_MEMBER} AS member, c, list_position(list_transform(r.pool, lambda m: ({_LIKE})), true) AS hit FROM r JOIN c2 c ON c.session_id = r.session_id AND c.type = r.type AND c.n = r.n + 1)),
e AS (SELECT session_id, type, unnest(pool) AS m FROM (SELECT *, row_number() OVER (PARTITION BY session_id, type ORDER BY n DESC) AS last FROM r) WHERE last = 1)
SELECT m.id, m.title, m.trigger_text, m.lesson, m.salience, m.volatile, array_to_string(m.domain, ',') AS domain, array_to_string(m.cited, ',') AS cited, array_to_string(m.secrets, ',') AS secrets, m.merged, session_id, type FROM e"""
ORACLE["unprocessed_versions"] = f"""WITH {_SES}, cur AS (SELECT ses.*, coalesce(r.content_hash, 'sha256:' || left(sha256(''), 16)) AS h FROM ses LEFT JOIN ({ORACLE['transcript_render']}) r ON r.session_id = ses.id)
SELECT id AS session_id, h AS content_hash, {_SLUG} AS project, strftime(make_timestamp(time_updated * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS time_end FROM cur
WHERE coalesce(trim(parent_id), '') IN ('', 'null') AND time_updated <= 1781481600000 - 21600000 AND NOT EXISTS (SELECT 1 FROM ledger WHERE pipeline_version = '1' AND ledger.session_id = cur.id AND ledger.content_hash = h)"""
