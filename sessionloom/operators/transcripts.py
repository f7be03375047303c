"""Sessions, messages and parts to rendered transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import hour_minute, iso_ms, js_length, js_trim, project_slug, short_hash
from sessionloom.operators.runs import running_totals
from sessionloom.runtime import in_force

#: Characters of a tool's input that a transcript shows.
INPUT_SHOWN = 160


def readable(c: str) -> Column:
    """Whether a text is a complete JSON object or array, which is what the reader of rows accepts."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def field(c: str, path: str) -> Column:
    return F.get_json_object(c, path)


def is_root(parent: str) -> Column:
    """Whether a session has no parent: none, blank or ``null``."""
    return F.coalesce(F.trim(parent), F.lit("")).isin("", "null")


def cut_units(c: Column, most: int) -> Column:
    """The first ``most`` UTF-16 units of a text; half a surrogate pair at the end is a replacement character."""
    units = F.encode(c, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * most - 1, 1)).rlike("^D[89AB]")
    return F.when(half, F.concat(F.decode(F.substring(units, 1, 2 * most - 2), "UTF-16BE"), F.lit("\ufffd"))).otherwise(F.decode(F.substring(units, 1, 2 * most), "UTF-16BE"))


def part_bodies(parts: DataFrame) -> DataFrame:
    """(message_id, part_id, body): trimmed texts and one line for each tool call; other kinds add nothing.

    A tool's input is cut after ``INPUT_SHOWN`` UTF-16 units.
    """
    p = in_force(parts, "id", "time_updated", ["id", "time_updated", "message_id", "data"]).where(readable("data"))
    kind, text, given = field("data", "$.type"), js_trim(field("data", "$.text")), F.coalesce(field("data", "$.state.input"), F.lit(""))
    cut = F.when(js_length(given) > INPUT_SHOWN, F.concat(cut_units(given, INPUT_SHOWN), F.lit("…"))).otherwise(given)
    line = F.concat(F.lit("> 🔧 "), F.coalesce(field("data", "$.tool"), F.lit("unknown")), F.lit(" "), cut, F.lit(" → "), F.coalesce(field("data", "$.state.status"), F.lit("?")))
    body = F.when((kind == "text") & (text != ""), text).when(kind == "tool", line)
    return p.select("message_id", F.col("id").alias("part_id"), body.alias("body")).where(F.col("body").isNotNull() & F.col("message_id").isNotNull())


def turns(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, turn from 1, message_id, user, block): the messages that say something, in (time, id) order.

    Unreadable rows and messages without content are left out. Turn numbers come from range-partitioned stretches,
    so one very long session is spread over many tasks.
    """
    m = in_force(messages, "id", "time_updated", ["id", "time_updated", "session_id", "time_created", "data"]).where(readable("data") & F.col("session_id").isNotNull())
    m = m.select(F.col("id").alias("message_id"), "session_id", "time_created", (F.coalesce(field("data", "$.role"), F.lit("")) == "user").alias("user"))
    said = part_bodies(parts).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "body"))).alias("b"))
    said = said.select("message_id", F.array_join(F.transform("b", lambda x: x["body"]), "\n\n").alias("text"))
    numbered = running_totals(m.join(said, "message_id"), ["session_id"], ["time_created", "message_id"], {"before": "1"})
    head = F.concat(F.lit("## T"), F.col("before") + 1, F.lit(" ["), hour_minute("time_created"), F.lit("] "), F.when(F.col("user"), "User").otherwise("Assistant"), F.lit(" {#"), F.col("message_id"), F.lit("}"))
    return numbered.select("session_id", (F.col("before") + 1).alias("turn"), "message_id", "user", F.concat(head, F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("block"))


def rendered(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, turns, user_turns, body, content_hash) of every session with a turn."""
    t = turns(messages, parts).groupBy("session_id").agg(
        F.count("*").alias("turns"), F.sum(F.col("user").cast("long")).alias("user_turns"), F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("b"),
    )
    body = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    return t.select("session_id", "turns", "user_turns", body.alias("body"), short_hash(body).alias("content_hash"))


def session_models(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, model): provider and id of the session's own model, else that of its last message that names one, else unknown."""
    s = in_force(sessions, "id", "time_updated", ["id", "time_updated", "model"])
    m = in_force(messages, "id", "time_updated", ["id", "time_updated", "session_id", "time_created", "data"]).where(readable("data"))
    named = F.nullif(field("data", "$.modelID"), F.lit(""))
    last = m.withColumn("m", named).where(F.col("m").isNotNull()).groupBy("session_id").agg(F.max_by("m", F.struct("time_created", F.col("id"))).alias("last"))
    ok = F.try_parse_json("model").isNotNull()
    own, provider = F.when(ok, F.nullif(field("model", "$.id"), F.lit(""))), F.when(ok, F.nullif(field("model", "$.providerID"), F.lit("")))
    model = F.coalesce(F.concat(provider, F.lit("/"), own), own, F.col("last"), F.lit("unknown"))
    return s.join(last.withColumnRenamed("session_id", "sid"), F.col("id") == F.col("sid"), "left").select("id", model.alias("model"))


def header(sessions: DataFrame, bodies: DataFrame, models: DataFrame, exported_at: str) -> DataFrame:
    """(session_id, markdown): the whole transcript file with its front matter."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)
    t = sessions.join(bodies, F.col("id") == F.col("session_id")).join(models, "id")
    lines = [
        F.lit("---"), F.concat(F.lit("session_id: "), "id"), F.concat(F.lit("project_dir: "), quoted("directory")), F.concat(F.lit("title: "), quoted("title")),
        F.concat(F.lit("model: "), quoted("model")), F.concat(F.lit("time_start: "), iso_ms("time_created")), F.concat(F.lit("time_end: "), iso_ms("time_updated")),
        F.concat(F.lit("turns: "), F.col("turns").cast("string")),
        F.concat(F.lit("tokens: { input: "), F.coalesce("tokens_input", F.lit(0)).cast("string"), F.lit(", output: "), F.coalesce("tokens_output", F.lit(0)).cast("string"), F.lit(" }")),
        F.concat(F.lit("content_hash: "), "content_hash"), F.concat(F.lit("exported_at: "), F.lit(exported_at)), F.lit("---"), F.lit(""),
    ]
    return t.select("session_id", F.concat(F.concat_ws("\n", *lines), "body").alias("markdown"))


def bundles(sessions: DataFrame, messages: DataFrame, parts: DataFrame, session_id: str | None = None) -> DataFrame:
    """(session_id, message_id, message_no, part_id, part_no): readable messages of the sessions by (time, id), readable
    parts by id, both numbered from 0; a message without parts has one row. With ``session_id`` those of one session:
    the filters reach the scans. Sessions that do not exist and rows without a session give nothing.
    """
    if session_id is not None:
        sessions, messages, parts = sessions.where(F.col("id") == session_id), messages.where(F.col("session_id") == session_id), parts.where(F.col("session_id") == session_id)
    s = in_force(sessions, "id", "time_updated", ["id", "time_updated"]).select(F.col("id").alias("session_id"))
    m = in_force(messages, "id", "time_updated", ["id", "time_updated", "session_id", "time_created", "data"]).where(readable("data") & F.col("session_id").isNotNull())
    m = running_totals(m.select("session_id", F.col("id").alias("message_id"), "time_created"), ["session_id"], ["time_created", "message_id"], {"message_no": "1"})
    p = in_force(parts, "id", "time_updated", ["id", "time_updated", "message_id", "data"]).where(readable("data") & F.col("message_id").isNotNull())
    p = running_totals(p.select("message_id", F.col("id").alias("part_id")), ["message_id"], ["part_id"], {"part_no": "1"})
    return m.join(s, "session_id", "left_semi").join(p, "message_id", "left").select("session_id", "message_id", "message_no", "part_id", "part_no")


def export_outcomes(sessions: DataFrame, bodies: DataFrame, exported: DataFrame, ignored: tuple[str, ...] = (), min_user_turns: int = 2) -> DataFrame:
    """What exporting each session comes to: ``outcome`` (skipped, unchanged, written), ``reason`` of skipping, ``slug``, ``parent_id``, ``content_hash``.

    ``sessions`` in force; ``bodies`` as ``rendered`` gives them (a session without turns has an empty body); ``exported``: (session_id,
    exported_hash) of what was written before. Skipped are sessions that bodies name and ``sessions`` lacks, children, projects in ``ignored``
    (equal to the slug or part of the directory) and sessions with too few turns of the user, in this order.
    """
    slug = project_slug("directory")
    t = sessions.withColumnRenamed("id", "session_id").withColumn("there", F.lit(True)).join(bodies.select("session_id", "user_turns", "content_hash"), "session_id", "full").join(exported, "session_id", "left")
    left_out = F.lit(False)
    for x in ignored:
        left_out = left_out | (slug == x) | F.contains("directory", F.lit(x))
    reason = (
        F.when(F.col("there").isNull(), "not found").when(~is_root("parent_id"), "child session").when(F.coalesce(left_out, F.lit(False)), "ignored project")
        .when(F.coalesce("user_turns", F.lit(0)) < min_user_turns, "too few user turns")
    )
    h = F.coalesce("content_hash", short_hash(F.lit("")))
    outcome = F.when(reason.isNotNull(), "skipped").when(F.col("exported_hash") == h, "unchanged").otherwise("written")
    return t.select("session_id", "parent_id", F.when(F.col("there"), slug).alias("slug"), outcome.alias("outcome"), reason.alias("reason"), h.alias("content_hash")).where("session_id IS NOT NULL")
