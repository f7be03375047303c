"""Rebuilding conversations from message rows (problem 5).

Turns are put in order after the clocks of the senders are brought together. A sender is a role; each has a clock of
its own, and the user's is the reference. Message ids are given out by one store in order of arrival, so of two
neighbours in id order by different senders the second answers the first: ``t1 + d(sender 1) <= t2 + d(sender 2)``.
Such pairs bound the differences of the offsets d. Of all offsets within the bounds those with the least sum of squared
corrections, taken over all messages, are the estimate; where the bounds contradict each other (a loop of them with
a negative sum) no offsets fit and the conversation is rejected as ``infeasible``.

A session with all its messages in agreement has offsets 0. There are at most twelve bounds for a session, each a
minimum, so a session that holds a third of all rows is reduced before the shuffle; neighbours in id order and turn
numbers come from range-partitioned stretches, not from one window for each session.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.runs import running_totals
from sessionloom.runtime import Scratch, in_force, table

ROLES = ("user", "assistant", "system", "tool")
#: Epoch values below this are in seconds.
SECONDS_BELOW = 100_000_000_000
#: Ordered pairs of senders: the second answers the first.
_PAIRS = list(itertools.permutations(range(len(ROLES)), 2))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _field(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "string")


def messages_in_force(messages: DataFrame) -> DataFrame:
    """message_id, session_id, t (ms), role; role is null where data is no complete object with a known role."""
    m = in_force(messages, "id", "time_updated", ["id", "time_updated", "session_id", "time_created", "data"])
    m = m.where(F.col("session_id").isNotNull()).withColumn("v", F.try_parse_json("data"))
    role = F.lower(_strip(_field("v", "$.role")))
    t = F.when(F.col("time_created") < SECONDS_BELOW, F.col("time_created") * 1000).otherwise(F.col("time_created"))
    return m.select(F.col("id").alias("message_id"), "session_id", t.alias("t"), F.when(role.isin(*ROLES), role).alias("role"))


def spoken(parts: DataFrame, texts: bool) -> DataFrame:
    """message_id, sessions, text: what each message's parts say in id order; null where no part speaks.

    Without ``texts`` the text is only empty or null, which is all that the verdicts need.
    """
    said = _strip(_field("v", "$.text"))
    text = F.when((_field("v", "$.type") == "text") & (said != ""), said if texts else F.lit(""))
    label = F.concat(F.lit("[tool "), F.coalesce(_field("v", "$.tool"), F.lit("unknown")), F.lit(": "), F.coalesce(_field("v", "$.state.status"), F.lit("?")), F.lit("]"))
    tool = F.when(_field("v", "$.type") == "tool", label if texts else F.lit(""))
    p = parts.select("id", "time_updated", "message_id", "session_id", "loaded_at", F.try_parse_json("data").alias("v"))
    p = in_force(p.withColumn("text", F.coalesce(text, tool)), "id", "time_updated", ["id", "time_updated", "message_id", "session_id", "text"]).where(F.col("session_id").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("id", "text")))), lambda x: x["text"]), "\n")
    both = joined if texts else F.max("text")
    return p.groupBy("message_id").agg(F.collect_set("session_id").alias("sessions"), F.when(F.max("text").isNotNull(), both).alias("text"))


def clock_offsets(bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feasible, offsets in ms) of many conversations at once.

    ``bounds``: for each conversation and ordered pair of senders (i, j) the greatest d(i) - d(j), nan where there is
    none; ``counts``: messages of each sender. The offsets minimise the sum of counts * d ** 2 with d(0) = 0. The closure of
    the bounds under addition tells whether they agree; the least squares are found by correcting one bound after
    another (each correction is remembered and taken back as far as later ones allow), and rounding to whole ms stays
    inside the closed bounds.
    """
    n, k = counts.shape
    room = np.full((n, k, k), np.inf)
    for p, (i, j) in enumerate(_PAIRS):
        room[:, i, j] = np.where(np.isnan(bounds[:, p]), np.inf, bounds[:, p])
    room[:, range(k), range(k)] = 0
    for m in range(k):
        room = np.minimum(room, room[:, :, m : m + 1] + room[:, m : m + 1, :])
    feasible = ~(room[:, range(k), range(k)] < 0).any(1)
    give = 1 / np.maximum(counts, 1)  # how easily a sender's clock moves
    give[:, 0] = 0
    d, held = np.zeros((n, k)), np.zeros((n, len(_PAIRS)))
    live = np.flatnonzero(feasible & np.any([room[:, i, j] < 0 for i, j in _PAIRS], axis=0))
    while len(live):
        moved = np.zeros(len(live))
        for p, (i, j) in enumerate(_PAIRS):
            over = d[live, i] - d[live, j] - room[live, i, j]
            step = np.maximum(-held[live, p], over / (give[live, i] + give[live, j]))
            held[live, p] += step
            d[live, i] -= step * give[live, i]
            d[live, j] += step * give[live, j]
            moved = np.maximum(moved, np.abs(step) * np.maximum(give[live, i], give[live, j]))
        live = live[moved > 1e-2]
    d = np.round(d)
    for j in range(1, k):
        low, high = (d[:, :j] - room[:, :j, j]).max(1), (d[:, :j] + room[:, j, :j]).min(1)
        d[:, j] = np.where(feasible, np.minimum(np.maximum(d[:, j], low), high), 0)
    return feasible, d


@F.pandas_udf(T.StructType([T.StructField("feasible", T.BooleanType()), *[T.StructField(r, T.LongType()) for r in ROLES]]))
def _offsets(bounds: pd.Series, counts: pd.Series) -> pd.DataFrame:
    full = lambda s, width, none: np.array([[none] * width if x is None else x for x in s], float).reshape(-1, width)
    feasible, d = clock_offsets(full(bounds, len(_PAIRS), np.nan), full(counts, len(ROLES), 0))
    return pd.DataFrame({"feasible": feasible} | {r: d[:, i].astype(np.int64) for i, r in enumerate(ROLES)})


def _bounds(said: DataFrame, scratch: Scratch) -> DataFrame:
    """session_id, bounds (for each of ``_PAIRS``, nan where no neighbours give one), counts (messages of each role)."""
    parts = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = said.select("session_id", "message_id", "t", "role").repartitionByRange(parts, "session_id", "message_id")
    placed = scratch.keep(placed.withColumn("at", F.spark_partition_id()), "by-id")
    # The last row of each stretch stands before the first row of the next stretch that has rows.
    edge = placed.groupBy("at").agg(F.max_by(F.struct("session_id", "message_id", "t", "role"), F.struct("session_id", "message_id")).alias("e"))
    edge = edge.select((F.lead("at").over(Window.partitionBy(F.lit(0)).orderBy("at"))).alias("at"), "e.*").where(F.col("at").isNotNull())  # a row for each partition
    both = placed.withColumn("own", F.lit(True)).unionByName(edge.withColumn("own", F.lit(False)))
    near = Window.partitionBy("at", "session_id").orderBy("message_id")
    pairs = both.select("session_id", "own", "t", "role", F.lag("t").over(near).alias("t0"), F.lag("role").over(near).alias("role0")).where("own")
    gap = (F.col("t") - F.col("t0")).cast("double")
    least = [F.coalesce(F.min(F.when((F.col("role0") == ROLES[i]) & (F.col("role") == ROLES[j]), gap)), F.lit(float("nan"))) for i, j in _PAIRS]
    counts = [F.sum((F.col("role") == r).cast("double")) for r in ROLES]
    return pairs.groupBy("session_id").agg(F.array(*least).alias("bounds"), F.array(*counts).alias("counts"))


def conversations(sessions: DataFrame, messages: DataFrame, parts: DataFrame, texts: bool = True, stated_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdicts, turns).

    verdicts: a row for each session that ``sessions``, messages or parts name: ``session_id``, ``reason`` (broken,
    empty, no_reply, infeasible, or null for a sound conversation) and the clock offsets in ms: ``offset_ms`` of the
    assistant, ``system_ms``, ``tool_ms``. A session without messages is ``empty``. turns, of the sound ones:
    ``session_id``, ``turn_no`` from 0, ``role``, ``message_id``, ``t`` (ms, corrected), ``text``.

    Whether the last word is a user's is taken from the times as they are stated, then the id; without
    ``stated_order`` from the corrected times. Null times sort first and bound nothing. Rows without an id or a session
    do not count. Of repeated rows the one in force holds. A turn is a user's or assistant's message that speaks; its
    text joins its parts in id order. Empty tables give empty results.
    """
    scratch = Scratch(messages.sparkSession, "conversations")
    known = sessions.where(F.col("id").isNotNull()).select(F.col("id").alias("session_id")).distinct().withColumn("known", F.lit(True))
    m = messages_in_force(messages).withColumn("there", F.lit(True))
    said = m.join(spoken(parts, texts), "message_id", "full")
    said = scratch.keep(said.select("message_id", "session_id", "t", "role", "there", "sessions", "text"), "said")
    speaks = F.col("text").isNotNull() & F.col("role").isin("user", "assistant")
    own = said.where("there").groupBy("session_id").agg(
        F.max(F.col("role").isNull()).alias("bad"), F.max(speaks).alias("any"), F.max(speaks & (F.col("role") == "user")).alias("user"),
        *[F.max(F.when(speaks & (F.col("role") == r), F.struct("t", "message_id"))).alias(f"last_{r}") for r in ("user", "assistant")],
    )
    named = said.select(F.explode("sessions").alias("session_id"), F.col("there").isNull().alias("orphan")).groupBy("session_id").agg(F.max("orphan").alias("orphan"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    said = said.where("there")
    all_ = own.join(named, "session_id", "full").join(known, "session_id", "full")
    heard_at_all = said.where(F.col("text").isNotNull() & F.col("role").isNotNull())
    all_ = all_.join(_bounds(heard_at_all, scratch), "session_id", "left").withColumn("clock", _offsets("bounds", "counts"))
    offset = F.col("clock.assistant")
    heard = F.struct((F.col("last_assistant.t") + (F.lit(0) if stated_order else offset)).alias("t"), F.col("last_assistant.message_id"))
    unanswered = F.col("last_assistant").isNull() | (F.col("last_user") > heard)
    reason = (
        F.when(~yes("known") | yes("bad") | yes("orphan"), "broken").when(~yes("any"), "empty")
        .when(~yes("user") | unanswered, "no_reply").when(~F.col("clock.feasible"), "infeasible")
    )
    verdicts = scratch.keep(all_.select("session_id", reason.alias("reason"), offset.alias("offset_ms"), F.col("clock.system").alias("system_ms"), F.col("clock.tool").alias("tool_ms")), "verdicts")
    sound = verdicts.where(F.col("reason").isNull()).select("session_id", "offset_ms")
    turns = said.where(speaks).join(sound, "session_id")
    turns = turns.select("session_id", "message_id", "role", (F.col("t") + F.when(F.col("role") == "assistant", F.col("offset_ms")).otherwise(0)).alias("t"), "text")
    turns = running_totals(turns, ["session_id"], ["t", "message_id"], {"turn_no": "1"}, scratch=scratch)
    return verdicts, turns.select("session_id", "turn_no", "role", "message_id", "t", "text")


def _tables(spark: SparkSession, sf_dir: str, texts: bool) -> tuple[DataFrame, DataFrame]:
    return conversations(*(table(spark, sf_dir, t) for t in ("sessions", "messages", "parts")), texts=texts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, False)[0].where(F.col("reason").isin("broken", "empty", "no_reply")).select("session_id", "reason")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, True)[1]


def p5_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every session the verdict with the offsets that bring its senders' clocks together, in ms."""
    return _tables(spark, sf_dir, False)[0]


_CTE = r"""
WITH m AS (SELECT id AS message_id, session_id, CASE WHEN time_created < 100000000000 THEN time_created * 1000 ELSE time_created END AS t,
  CASE WHEN json_valid(data) AND json_type(CASE WHEN json_valid(data) THEN data ELSE 'null' END) = 'OBJECT' THEN lower(trim(json_extract_string(CASE WHEN json_valid(data) THEN data ELSE 'null' END, '$.role'))) END AS role
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, loaded_at DESC) AS rn FROM messages WHERE id IS NOT NULL) WHERE rn = 1 AND session_id IS NOT NULL),
p0 AS (SELECT id, message_id, session_id, CASE WHEN json_valid(data) THEN data ELSE 'null' END AS data
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, loaded_at DESC) AS rn FROM parts WHERE id IS NOT NULL) WHERE rn = 1 AND session_id IS NOT NULL),
p AS (SELECT id, message_id, session_id, CASE WHEN json_extract_string(data, '$.type') = 'tool' THEN concat('[tool ', coalesce(json_extract_string(data, '$.tool'), 'unknown'), ': ', coalesce(json_extract_string(data, '$.state.status'), '?'), ']')
  WHEN json_extract_string(data, '$.type') = 'text' AND regexp_replace(json_extract_string(data, '$.text'), '\s', '', 'g') <> '' THEN trim(json_extract_string(data, '$.text'), E' \t\n\r') END AS text FROM p0),
x AS (SELECT message_id, string_agg(text, E'\n' ORDER BY id) AS text FROM p WHERE text IS NOT NULL GROUP BY 1),
s AS (SELECT m.*, x.text, (x.text IS NOT NULL AND m.role IN ('user', 'assistant')) AS speaks FROM m LEFT JOIN x USING (message_id)),
per AS (SELECT session_id, bool_or(role IS NULL OR role NOT IN ('user', 'assistant', 'system', 'tool')) AS bad, bool_or(speaks) AS any_said, bool_or(speaks AND role = 'user') AS u,
  arg_max(role, (t, message_id)) FILTER (WHERE speaks) AS last_role FROM s GROUP BY 1),
named AS (SELECT session_id FROM m UNION SELECT session_id FROM p UNION SELECT id FROM sessions WHERE id IS NOT NULL),
verdict AS (SELECT n.session_id, CASE WHEN n.session_id NOT IN (SELECT id FROM sessions WHERE id IS NOT NULL) OR per.bad OR n.session_id IN (SELECT session_id FROM p WHERE message_id IS NULL OR message_id NOT IN (SELECT message_id FROM m)) THEN 'broken'
  WHEN NOT coalesce(any_said, false) THEN 'empty' WHEN NOT u OR last_role = 'user' THEN 'no_reply' END AS reason FROM named n LEFT JOIN per USING (session_id))
"""

QUERIES = {"p5_found": p5_found, "p5_turns": p5_turns, "p5_clocks": p5_clocks}
ORACLE = {
    "p5_found": _CTE + "SELECT session_id, reason FROM verdict WHERE reason IS NOT NULL",
    # No clock of these tables is off, so the stated order is the corrected one.
    "p5_turns": _CTE + "SELECT s.session_id, row_number() OVER (PARTITION BY s.session_id ORDER BY t, message_id) - 1 AS turn_no, role, message_id, t, text FROM s JOIN verdict v ON v.session_id = s.session_id AND v.reason IS NULL WHERE speaks",
}
