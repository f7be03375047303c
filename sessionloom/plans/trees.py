"""Queries of problem 4: the session forest and the forest of replaced memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.hierarchy import descendants, hierarchy
from sessionloom.runtime import in_force, table, trimmed_link

#: Joins the forest's name to an id, so that both forests are solved in one run.
_MARK = "\x1f"


def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and parent_id of both forests, each id led by the forest's name."""
    s = in_force(table(spark, sf_dir, "sessions"), "id", "time_updated", ["id", "time_updated", "parent_id"])
    s = s.select(F.lit("sessions").alias("forest"), "id", trimmed_link("parent_id").alias("parent"))
    m = in_force(table(spark, sf_dir, "memories"), "id", "updated_at", ["id", "updated_at", "superseded_by", "supersedes"])
    m = m.select("id", trimmed_link("superseded_by").alias("by"), trimmed_link("supersedes").alias("old"))
    named = m.where(F.col("old").isNotNull()).groupBy(F.col("old").alias("id")).agg(F.min("id").alias("named_by"))
    m = m.join(named, "id", "left").select(F.lit("memories").alias("forest"), "id", F.coalesce("by", "named_by").alias("parent"))
    mark = lambda c: F.concat(F.col("forest"), F.lit(_MARK), F.col(c))
    return s.unionByName(m).select(mark("id").alias("node_id"), mark("parent").alias("parent_id"))


def _plain(c: str):
    return F.when(F.col(c) == "cycle", F.col(c)).otherwise(F.substring_index(F.col(c), _MARK, -1))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hierarchy(parent_links(spark, sf_dir), with_paths=False).where(F.col("parent_id").isNotNull())
    return t.select(F.substring_index("node_id", _MARK, 1).alias("forest"), _plain("node_id").alias("node_id"), _plain("root_id").alias("root_id"), "depth")


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session and memory with its path as one text, and the loop's least id where it runs into one."""
    t = hierarchy(parent_links(spark, sf_dir))
    path = F.concat_ws("/", F.transform("path", lambda x: F.substring_index(x, _MARK, -1)))
    return t.select(
        F.substring_index("node_id", _MARK, 1).alias("forest"), _plain("node_id").alias("node_id"), _plain("root_id").alias("root_id"), "depth",
        F.when(F.col("path").isNotNull(), path).alias("path"), _plain("loop_id").alias("loop_id"), "dangling",
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = descendants(hierarchy(parent_links(spark, sf_dir)))
    return t.select(F.substring_index("node_id", _MARK, 1).alias("forest"), _plain("node_id").alias("node_id"), _plain("descendant_id").alias("descendant_id"), "distance")


_TREE = r"""
WITH RECURSIVE link AS (
 SELECT 'sessions' AS forest, id, CASE WHEN trim(parent_id, E' \t\n\r') = '' OR lower(trim(parent_id, E' \t\n\r')) = 'null' THEN NULL ELSE trim(parent_id, E' \t\n\r') END AS parent
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, loaded_at DESC) AS rn FROM sessions WHERE id IS NOT NULL) WHERE rn = 1
 UNION ALL
 SELECT 'memories', m.id, coalesce(m.by, n.named_by) FROM (
  SELECT id, CASE WHEN trim(superseded_by) = '' OR lower(trim(superseded_by)) = 'null' THEN NULL ELSE trim(superseded_by) END AS by
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM memories WHERE id IS NOT NULL) WHERE rn = 1) m
 LEFT JOIN (SELECT trim(supersedes) AS old, min(id) AS named_by
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM memories WHERE id IS NOT NULL)
  WHERE rn = 1 AND trim(supersedes) <> '' AND lower(trim(supersedes)) <> 'null' GROUP BY 1) n ON n.old = m.id),
up AS (SELECT l.forest, l.id, l.parent, p.id AS real_parent FROM link l LEFT JOIN link p ON p.forest = l.forest AND p.id = l.parent),
walk AS (
 SELECT forest, id AS node_id, id AS at_id, real_parent AS next_id, 0 AS depth, [id] AS seen, false AS looped FROM up
 UNION ALL
 SELECT w.forest, w.node_id, u.id, u.real_parent, w.depth + 1, list_append(w.seen, u.id), list_contains(w.seen, u.id)
 FROM walk w JOIN up u ON u.forest = w.forest AND u.id = w.next_id WHERE NOT w.looped),
ends AS (SELECT * FROM walk WHERE looped OR next_id IS NULL)
"""

ORACLE = {
    "p4_found": _TREE + """
SELECT e.forest, e.node_id, CASE WHEN looped THEN 'cycle' ELSE at_id END AS root_id, CAST(CASE WHEN looped THEN -1 ELSE e.depth END AS BIGINT) AS depth
FROM ends e JOIN up u ON u.forest = e.forest AND u.id = e.node_id WHERE u.parent IS NOT NULL""",
    "p4_hierarchy": _TREE + """
SELECT e.forest, e.node_id, CASE WHEN looped THEN 'cycle' ELSE at_id END AS root_id, CAST(CASE WHEN looped THEN -1 ELSE e.depth END AS BIGINT) AS depth,
 CASE WHEN looped THEN NULL ELSE array_to_string(list_reverse(seen), '/') END AS path,
 CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, at_id), len(seen))) END AS loop_id,
 u.parent IS NOT NULL AND u.real_parent IS NULL AS dangling
FROM ends e JOIN up u ON u.forest = e.forest AND u.id = e.node_id""",
    "p4_descendants": _TREE + """
SELECT w.forest, w.at_id AS node_id, w.node_id AS descendant_id, CAST(w.depth AS BIGINT) AS distance
FROM walk w JOIN ends e ON e.forest = w.forest AND e.node_id = w.node_id AND NOT e.looped WHERE w.depth > 0""",
}

QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}
