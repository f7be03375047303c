"""Transcript files, memory-record files and the ledger as line-wise JSON.

Readers keep what can be read and leave out what cannot, as the scanners of such a store do: a file without its
required fields gives no row, a torn ledger line is skipped and counted by ``unreadable_lines``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.text import js_trim

LEDGER = "session_id string, content_hash string, pipeline_version string, extractor_model string, processed_at string, n_candidates long, n_committed long"
# The fields that a transcript and a memory record must have, and the values that they may take.
TRANSCRIPT_FIELDS = ("session_id", "content_hash", "time_end", "exported_at", "title")
RECORD_FIELDS = ("id", "memory_class", "type", "title", "trigger", "project", "scope", "domain", "volatile", "confidence", "status", "superseded_by", "supersedes", "promoted_from", "absorbs", "review", "evidence", "provenance", "created_at", "updated_at")
ENUMS = {
    "memory_class": ("episodic", "semantic", "procedural"),
    "type": ("decision", "root_cause", "pitfall", "know_how", "convention", "workflow"),
    "scope": ("project", "global"),
    "status": ("candidate", "active", "superseded", "quarantined", "archived"),
    "review": ("auto", "human_pending", "human_approved"),
}
_EVIDENCE = "array<struct<session string, anchors array<string>, observed_at string>>"
_PROVENANCE = "struct<extractor string, prompt_hash string>"


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every .md file below a folder."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def front_matter(text: str | Column) -> tuple[Column, Column]:
    """(fields, body): the raw values of the first ``---`` block by name, and what follows it; null without a block."""
    text = F.col(text) if isinstance(text, str) else text
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ": ") > 1)
    # Of repeated names the last counts.
    pairs = F.aggregate(lines, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.substring_index(x, ": ", 1)), F.create_map(F.substring_index(x, ": ", 1), js_trim(F.substring(x, F.instr(x, ": ") + 2, F.length(x))))))
    has = text.rlike(r"(?s)\A---\n.*?\n---(\n|\z)")
    return F.when(has, pairs), F.when(has, F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", ""))


def unquoted(value: Column) -> Column:
    """A value without its JSON quotes; as it is if it has none or they do not close."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")
    return F.when(value.startswith('"'), F.coalesce(inner, value)).otherwise(value)


def transcripts(files: DataFrame) -> DataFrame:
    """(path, project, session_id, content_hash, time_end, exported_at, title, body) of readable transcript files."""
    fields, body = front_matter("text")
    t = files.select("path", fields.alias("f"), body.alias("body"))
    t = t.select("path", F.element_at(F.split("path", "/"), -2).alias("project"), *[unquoted(F.col("f")[k]).alias(k) for k in TRANSCRIPT_FIELDS], "body")
    complete = F.lit(True)
    for k in TRANSCRIPT_FIELDS:
        complete = complete & (F.coalesce(F.col(k), F.lit("")) != "")
    return t.where(complete)


def record_text() -> Column:
    """A memory record's columns as the text of its file; reading it back gives the same values."""

    def quoted(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)

    def value(c: str) -> Column:
        v = F.col(c)
        plain = v.rlike(r"^[A-Za-z_][^\n\r\"]*\S$") & ~v.rlike(r"^(?:true|false|null)$")
        return F.when(v.isNull(), "null").when(plain, v).otherwise(quoted(v))

    lists = {"domain", "absorbs", "evidence", "provenance"}
    plain = {"volatile", "confidence"}
    source = {"trigger": "trigger_text"}
    lines = []
    for k in RECORD_FIELDS:
        c = source.get(k, k)
        text = F.coalesce(F.to_json(c), F.lit("null")) if k in lists else F.coalesce(F.col(c).cast("string"), F.lit("null")) if k in plain else value(c)
        lines.append(F.concat(F.lit(f"{k}: "), text))
    notes = F.when(F.size("notes") > 0, F.concat(F.lit("\n\n## Notes\n\n"), F.array_join(F.transform("notes", lambda n: F.concat(F.lit("- "), quoted(n))), "\n"))).otherwise("")
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), js_trim(F.coalesce("lesson", F.lit(""))), notes, F.lit("\n"))


#: Ends each text in a file of many.
MARK = "\x1e\n"


def write_texts(df: DataFrame, folder: str) -> None:
    """Writes texts (text) as files of many texts each, through Spark's own writer, each text ended by ``MARK``."""
    df.select("text").where("text IS NOT NULL").write.mode("append").option("lineSep", MARK).text(folder)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of texts that ``write_texts`` wrote; path is the file of many."""
    t = spark.read.option("lineSep", MARK).text(folder)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def records(files: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Memory records from their files: the record's columns, ``path``, the columns in ``more``, and ``errors`` naming the fields that fail.

    Filter on ``size(errors) = 0`` for the sound ones.
    """
    fields, body = front_matter("text")
    t = files.select("path", *(more or []), fields.alias("f"), body.alias("body"))
    raw = lambda k: F.when(F.col("f")[k] != "null", unquoted(F.col("f")[k]))
    notes = F.regexp_extract("body", r"(?s)\n\n## Notes\n\n((?:- [^\n]*\n?)+)\s*\z", 1)
    t = t.select(
        "path", *(more or []), "f", *[raw(k).alias("trigger_text" if k == "trigger" else k) for k in RECORD_FIELDS if k not in ("domain", "absorbs", "evidence", "provenance", "volatile", "confidence")],
        F.from_json(F.col("f")["domain"], "array<string>").alias("domain"), F.from_json(F.col("f")["absorbs"], "array<string>").alias("absorbs"),
        F.from_json(F.col("f")["evidence"], _EVIDENCE).alias("evidence"), F.from_json(F.col("f")["provenance"], _PROVENANCE).alias("provenance"),
        F.expr("try_cast(f['volatile'] AS boolean)").alias("volatile"), F.expr("try_cast(f['confidence'] AS double)").alias("confidence"),
        js_trim(F.regexp_replace("body", r"(?s)\n\n## Notes\n\n(?:- [^\n]*\n?)+\s*\z", "")).alias("lesson"),
        F.transform(F.filter(F.split(notes, "\n"), lambda x: x.startswith("- ")), lambda x: unquoted(F.substring(x, 3, F.length(x)))).alias("notes"),
    )
    bad = [F.when(F.col("f").isNull(), "front matter")]
    bad += [F.when(F.coalesce(F.col("trigger_text" if k == "trigger" else k), F.lit("")) == "", k) for k in ("id", "title", "trigger", "project", "created_at", "updated_at")]
    bad += [F.when(~F.coalesce(F.col(k).isin(*v), F.lit(False)), k) for k, v in ENUMS.items()]
    bad += [F.when(F.col(k).isNull(), k) for k in ("domain", "evidence", "provenance", "volatile")]
    bad += [F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"), F.when(F.col("f")["superseded_by"].isNull(), "superseded_by")]
    return t.withColumn("errors", F.array_compact(F.array(*bad))).drop("f")


def write_files(df: DataFrame, folder: str) -> None:
    """Writes each row (path, text) to its own file below a folder that all executors share.

    A file is written beside its place and moved there, so a repeated task leaves whole files.
    """

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            to = os.path.join(folder, r.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="") as out:
                out.write(r.text)
            os.replace(part, to)

    df.select("path", "text").where("path IS NOT NULL AND text IS NOT NULL").foreachPartition(write)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows from JSON lines, without lines that are torn or lack a key."""
    t = spark.read.schema(LEDGER + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return t.where("_broken IS NULL AND session_id IS NOT NULL AND content_hash IS NOT NULL AND pipeline_version IS NOT NULL").drop("_broken")


def unreadable_lines(spark: SparkSession, path: str) -> int:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull()).count()


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.select([c.split()[0] for c in LEDGER.split(", ")]).write.mode("append").json(path)
