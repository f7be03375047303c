"""Ranked search over records with the columns id, title, trigger_text, lesson and domain.

Null texts count as empty. Filters that are None or empty do not filter. Ties end with the id, so results do not
depend on the partitioning.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import count_apart, count_overlapping
from sessionloom.operators.prefix_join import query_tokens

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3, "trigger_text": 2, "lesson": 1, "domain": 2}


def _fields() -> list[Column]:
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "trigger_text", "lesson")]
    return [*text, F.coalesce(F.array_join("domain", " "), F.lit(""))]


def _occurrences(text: Column, word: str) -> Column:
    """Overlapping occurrences; a word that cannot overlap itself is counted without a regular expression."""
    low = word.lower()
    overlaps = any(low.startswith(low[i:]) for i in range(1, len(low)))
    return count_overlapping(text, word) if overlaps else count_apart(text, word)


def metadata(df: DataFrame, project: str | None = None, kind: str | None = None, status: str | None = None, min_confidence: float | None = None) -> DataFrame:
    for c, v in (("project", project), ("type", kind), ("status", status)):
        if v:
            df = df.where(F.col(c) == v)
    return df if min_confidence is None else df.where(F.col("confidence") >= min_confidence)


def bm25(df: DataFrame, query: str, limit: int | None = None, **filters) -> DataFrame:
    """df's matching rows with ``score`` (lower is better): BM25 over trigram phrases of the query's words.

    Word counts, lengths and document frequencies are taken over the whole table before the filters, in one
    aggregation to a single row. Words of fewer than three characters do not count; without any there are no rows.
    """
    words = [t for t in query_tokens(query) if len(t) >= 3]
    if not words:
        return df.limit(0).withColumn("score", F.lit(0.0))
    fields, whole = _fields(), F.concat_ws("\x1f", *_fields())  # no word spans the separator
    t = df.withColumn("_d", reduce(add, [F.greatest(F.length(f) - 2, F.lit(0)) for f in fields]).cast("double"))
    t = t.withColumns({f"_f{i}": _occurrences(whole, w).cast("double") for i, w in enumerate(words)})
    totals = t.agg(F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_n{i}") for i in range(len(words))])
    t = metadata(t, **filters).where(reduce(or_, [F.col(f"_f{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(totals))  # one row

    def part(i: int) -> Column:
        raw = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        f = F.col(f"_f{i}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))

    scored = t.withColumn("score", -reduce(add, [part(i) for i in range(len(words))])).select(*df.columns, "score")
    return scored if limit is None else scored.orderBy("score", "id").limit(limit)


def like(df: DataFrame, query: str, limit: int, **filters) -> DataFrame:
    """Rows that contain any word of the query in any field, best confidence first; score is 0."""
    words = query_tokens(query)
    hit = reduce(or_, [F.contains(F.lower(f), F.lit(w.lower())) for f in _fields() for w in words], F.lit(False))
    return metadata(df, **filters).where(hit).withColumn("score", F.lit(0.0)).orderBy(F.desc("confidence"), "id").limit(limit)


def weighted_scan(df: DataFrame, query: str, limit: int, **filters) -> DataFrame:
    """Rows by the weighted number of places where words of the query stand; score is its negative."""
    words = query_tokens(query)
    places = [w * count_apart(f, t) for f, w in zip(_fields(), FIELD_WEIGHTS.values(), strict=True) for t in words]
    score = -reduce(add, places, F.lit(0)).cast("double")
    t = metadata(df, **filters).withColumn("score", score).where(F.col("score") < 0)
    return t.orderBy("score", F.desc("confidence"), "id").limit(limit)


def reranked(hits: DataFrame, now: str, limit: int = 10, domain: str | None = None) -> DataFrame:
    """The best of a fetched pool by its rank, less its confidence, less 0.75 if it changed in the last 30 days.

    ``hits`` is a pool of bounded size, already cut by a limit; ranks are taken after the domain filter.
    """
    if domain:
        hits = hits.where(F.array_contains("domain", domain))
    rank = F.row_number().over(Window.orderBy("score", "id")) - 1
    recent = F.to_timestamp("updated_at") >= F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 30 DAYS")
    t = hits.withColumn("rank", rank).withColumn("merit", F.col("rank") - F.col("confidence") - F.when(recent, 0.75).otherwise(0.0))
    return t.orderBy("merit", "rank").limit(min(limit, 50))


def search(df: DataFrame, query: str, now: str, project: str | None = None, kind: str | None = None, domain: str | None = None, include_tentative: bool = False, limit: int = 10) -> DataFrame:
    """The whole search: active records of confidence 0.5 or more (any, with ``include_tentative``) by BM25, the best 30 (or ``limit``, 50 at
    most) fetched, then filtered by domain and ranked again; so a domain filter may leave fewer rows than the limit."""
    limit = min(limit, 50)
    pool = bm25(df, query, limit=max(30, limit), project=project, kind=kind, status="active", min_confidence=0.0 if include_tentative else 0.5)
    return reranked(pool, now, limit=limit, domain=domain)


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """The record of an id, or no row; the filter reaches the scan."""
    return df.where(F.col("id") == id_).limit(1)
