"""Operators on memory records, candidates and the processing ledger."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import js_length, js_trim, secret_labels, words
from sessionloom.operators.components import components
from sessionloom.operators.prefix_join import joined_classes, similar_classes
from sessionloom.operators.runs import running_totals
from sessionloom.runtime import Scratch

# The record types.
TYPES = ("decision", "root_cause", "pitfall", "know_how", "convention", "workflow")


# ---- clusters


def clusters(records: DataFrame, threshold: float = 0.35, least: int = 2, cap: int = 12) -> DataFrame:
    """(domain, size, members, place): groups of alike records (id, domain, text, confidence) under each tag.

    Records of a tag that steps of similarity join are a group; of more than ``cap`` members those of the highest
    confidence, then least id, stay, as the report is defined. Equal member lists of several tags are given once, under
    the least tag. Repeated tags of a record count once; null tags are left out. ``place`` orders the groups, largest first.
    """
    scratch = Scratch(records.sparkSession, "clusters")
    tagged = records.select("id", F.explode(F.array_distinct("domain")).alias("block"), "text", "confidence").where(F.col("block").isNotNull() & F.col("id").isNotNull())
    tagged = scratch.keep(tagged, "tagged")
    membership, edges = joined_classes(tagged, threshold, scratch)
    roots = components(edges, scratch)
    scratch.drop("edges")
    placed = membership.withColumn("node", F.xxhash64("block", "class_id")).join(roots, "node", "left").select("id", "block", F.coalesce("root", "node").alias("root"))
    ranked = placed.join(tagged.groupBy("id", "block").agg(F.max("confidence").alias("confidence")), ["id", "block"])
    sizes = ranked.groupBy("block", "root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = ranked.join(sizes, ["block", "root"])
    best = F.row_number().over(Window.partitionBy("block", "root").orderBy(F.desc_nulls_last("confidence"), "id"))
    kept = ranked.withColumn("rank", best).where(F.col("rank") <= cap)
    listed = kept.groupBy("block", "root").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"), F.count("*").alias("size"))
    groups = listed.groupBy("members").agg(F.min("block").alias("domain"), F.max("size").alias("size")).withColumns({"all": F.lit(0), "falling": -F.col("size")})
    return running_totals(groups, ["all"], ["falling", "members"], {"place": "1"}, scratch=scratch.part("order")).select("domain", "size", "members", "place")


#: Fixed value: what stands before the member ids in the note of a record that was made from a cluster.
DERIVED = "derived from: "


def tagged_clusters(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(members, tag, known): the tag that names a cluster's members, and whether a note of ``records`` (notes) ends in exactly it."""
    note = records.select(F.explode("notes").alias("note")).where(F.col("note").contains(DERIVED))
    tags = note.select(F.expr(f"substring(note, instr(note, '{DERIVED}'))").alias("tag"), F.lit(True).alias("known")).distinct()
    t = groups.select("members", F.concat(F.lit(DERIVED), "members").alias("tag"))
    return t.join(tags, "tag", "left").select("members", "tag", F.coalesce("known", F.lit(False)).alias("known"))


# ---- candidates


def validated(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Each candidate row's ``reasons`` for rejection (empty for a sound one) and ``secrets``.

    ``known``: (session_id, message_id) that may be cited. One leading # of a cited id is ignored. Cited ids meet the
    known ones by a join on both columns, so a session with very many messages is no single row.
    """
    c = candidates.withColumn("_row", F.xxhash64(*[F.col(x).cast("string") for x in candidates.columns]))
    blank = lambda x: F.coalesce(js_trim(x), F.lit("")) == ""
    cited = c.select("_row", "session_id", F.explode("evidence").alias("e")).select("_row", "session_id", F.regexp_replace(F.col("e.message_id"), "^#", "").alias("message_id")).distinct()
    missing = cited.where(F.col("message_id").isNotNull()).join(known.select("session_id", "message_id").distinct(), ["session_id", "message_id"], "left_anti")
    missing = missing.groupBy("_row").agg(F.count("*").alias("missing"))
    t = c.join(missing, "_row", "left")
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), F.lit("type")),
        *[F.when(blank(x), F.lit(x)) for x in ("title", "trigger_text", "lesson")],
        F.when(words(F.coalesce("lesson", F.lit(""))) > 80, F.lit("lesson exceeds 80 words")),
        F.when(F.coalesce(F.size("domain") <= 0, F.lit(True)) | F.exists("domain", lambda d: d.isNull() | (d == "")), F.lit("domain")),
        F.when(F.coalesce(F.size("evidence") <= 0, F.lit(True)), F.lit("evidence")),
        F.when(F.exists("evidence", lambda e: e["message_id"].isNull()), F.lit("evidence without message")),
        F.when(F.col("missing") > 0, F.lit("unknown message")),
        F.when(F.col("salience").isNull(), F.lit("salience")),
        F.when(F.col("volatile").isNull(), F.lit("volatile")),
    ))
    text = F.concat_ws(" ", "title", "trigger_text", "lesson")
    return t.select(*candidates.columns, reasons.alias("reasons"), secret_labels(text).alias("secrets"))


class _Pool:
    """Members of an open pool in order, found by trigger, by words that alike titles must share, or by a title without words."""

    def __init__(self):
        self.members: list[dict] = []
        self.index: dict[tuple[str, str], set[int]] = {}

    @staticmethod
    def keys(m: dict) -> list[tuple[str, str]]:
        words = sorted(m["tokens"])
        head = words[: len(words) - math.ceil(0.6 * len(words) - 1e-9) + 1]  # titles alike to 0.6 share one of these
        return [("trigger", m["trigger_text"]), *(("word", w) for w in head), *([] if words else [("raw", m["raw"])])]

    def first_like(self, new: dict) -> dict | None:
        met = set().union(*[self.index.get(k, ()) for k in self.keys(new)])
        for i in sorted(met):
            m = self.members[i]
            both = len(new["tokens"] | m["tokens"])
            alike = len(new["tokens"] & m["tokens"]) >= 0.6 * both if both else new["raw"] == m["raw"]
            if new["trigger_text"] == m["trigger_text"] or alike:
                return m
        return None

    def add(self, m: dict) -> None:
        m["at"] = len(self.members)
        self.members.append(m)
        self._place(m)

    def _place(self, m: dict) -> None:
        for k in self.keys(m):
            self.index.setdefault(k, set()).add(m["at"])

    def replace(self, m: dict, new: dict) -> None:
        """Gives a member the texts of another candidate."""
        for k in self.keys(m):
            self.index[k].discard(m["at"])
        m.update({k: new[k] for k in ("id", "title", "trigger_text", "lesson", "size", "tokens", "raw")})
        self._place(m)


def _fold(frames):
    """Sorted rows of one pool after another; holds the pool that is open."""
    pool, open_ = _Pool(), None

    def close():
        return pd.DataFrame([(m["pool"], m["id"], m["title"], m["trigger_text"], m["lesson"], m["salience"], m["volatile"], ",".join(m["domain"]), ",".join(m["cited"]), ",".join(sorted(m["secrets"])), m["merged"]) for m in pool.members], columns=["pool", "id", "title", "trigger_text", "lesson", "salience", "volatile", "domain", "cited", "secrets", "merged"])

    for f in frames:
        for r in f.to_dict("records"):
            if r["pool"] != open_:
                if pool.members:
                    yield close()
                pool, open_ = _Pool(), r["pool"]
            new = {k: r[k] for k in ("pool", "id", "title", "trigger_text", "lesson", "size", "volatile", "salience")} | {
                "tokens": frozenset(r["tokens"]), "raw": r["title_trimmed"], "merged": 0, "secrets": set(r["secrets"]),
                "domain": list(dict.fromkeys(r["domain"])), "cited": list(dict.fromkeys(r["cited"])),
            }
            m = pool.first_like(new)
            if m is None:
                pool.add(new)
                continue
            if new["size"] > m["size"]:
                pool.replace(m, new)
            m["domain"] = list(dict.fromkeys(m["domain"] + new["domain"]))
            m["cited"] = list(dict.fromkeys(m["cited"] + new["cited"]))
            m["secrets"] |= new["secrets"]
            m["salience"] = max(m["salience"], new["salience"])
            m["volatile"] = m["volatile"] or new["volatile"]
            m["merged"] += 1
    if pool.members:
        yield close()


def deduplicated(candidates: DataFrame) -> DataFrame:
    """The pools of candidates (session_id, pos, id, type, ...) after greedy merging in order of (pos, id).

    A candidate merges into the first pool member of its session and type that has its trigger or an alike title
    (0.6 or more), and is compared with what members have become. A member's title and trigger always are those of
    one of its candidates, so a merge follows a link between two original candidates: each connected part of those
    links is a pool of its own with the same result. A part streams through a task in order; only its open members
    are held. ``secrets`` has the labels of all secrets in a member's candidates. Null texts are empty, null salience is 0, null flags are false; rows without id are left out.
    """
    scratch = Scratch(candidates.sparkSession, "pools")
    blank = lambda x: F.coalesce(F.col(x), F.lit(""))
    c = candidates.where(F.col("id").isNotNull()).select(
        F.concat_ws("\x1f", blank("session_id"), blank("type")).alias("block"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "id", blank("title").alias("title"), blank("trigger_text").alias("trigger_text"), blank("lesson").alias("lesson"),
        F.coalesce("salience", F.lit(0.0)).alias("salience"), F.coalesce("volatile", F.lit(False)).alias("volatile"), F.coalesce("domain", F.array().cast("array<string>")).alias("domain"),
        F.coalesce(F.transform("evidence", lambda e: F.regexp_replace(e["message_id"], "^#", "")), F.array().cast("array<string>")).alias("cited"),
    )
    c = c.groupBy("id", "block").agg(F.min(F.struct(*[x for x in c.columns if x not in ("id", "block")])).alias("m")).select("id", "block", "m.*")
    c = scratch.keep(c.withColumns({"cited": F.array_compact("cited"), "domain": F.array_compact("domain"), "n": F.xxhash64("block", "id")}), "rows")
    membership, links = similar_classes(c.select("id", "block", F.col("title").alias("text")), 0.6, scratch)
    node = lambda x: F.xxhash64("block", F.col(x))
    same_title = membership.where("id <> class_id").select(node("id").alias("a"), node("class_id").alias("b"))
    same_trigger = c.join(c.groupBy("block", "trigger_text").agg(F.min("id").alias("first")), ["block", "trigger_text"]).where("id <> first").select(node("id").alias("a"), node("first").alias("b"))
    edges = links.select(node("a").alias("a"), node("b").alias("b")).union(same_title).union(same_trigger)
    roots = components(edges, scratch)
    pooled = c.join(roots, F.col("n") == F.col("node"), "left").withColumn("pool", F.coalesce("root", "n"))
    tokens = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))
    secrets = secret_labels(F.concat_ws(" ", "title", "trigger_text", "lesson")).alias("secrets")
    ready = pooled.select("pool", "pos", secrets, "id", "title", js_trim("title").alias("title_trimmed"), "trigger_text", "lesson", js_length("lesson").alias("size"), "salience", "volatile", "domain", "cited", tokens.alias("tokens"))
    out = ready.repartition("pool").sortWithinPartitions("pool", "pos", "id").mapInPandas(_fold, "pool long, id string, title string, trigger_text string, lesson string, salience double, volatile boolean, domain string, cited string, secrets string, merged long")
    return out.drop("pool").join(c.select("id", F.substring_index("block", "\x1f", 1).alias("session_id"), F.substring_index("block", "\x1f", -1).alias("type")).distinct(), "id")


def consensus(votes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, voted, panel): the lower median of the votes in [0, 10]; others and null abstain."""
    v = F.col(value)
    ok = F.when((v >= 0) & (v <= 10), v)
    return votes.where(F.col(key).isNotNull()).groupBy(key).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {value} BETWEEN 0 AND 10 THEN {value} END)").alias("median"), F.count(ok).alias("voted"), F.count("*").alias("panel"))


# ---- records


def evidence_union(records: DataFrame) -> DataFrame:
    """(id, session, anchors, observations): each record's evidence by session, anchors in first-seen order, once each."""
    e = records.select("id", F.posexplode("evidence").alias("at", "e")).select("id", "at", "e.session", "e.anchors")
    e = e.where(F.col("session").isNotNull())
    seen = e.select("id", "session", "at", F.posexplode("anchors").alias("i", "anchor")).groupBy("id", "session", "anchor").agg(F.min(F.struct("at", "i")).alias("first"))
    listed = seen.groupBy("id", "session").agg(F.array_sort(F.collect_list(F.struct("first", "anchor"))).alias("x"))
    listed = listed.select("id", "session", F.array_join(F.transform("x", lambda s: s["anchor"]), ",").alias("anchors"))
    counts = e.groupBy("id", "session").agg(F.count("*").alias("observations"))
    return counts.join(listed, ["id", "session"], "left").select("id", "session", F.coalesce("anchors", F.lit("")).alias("anchors"), "observations")


def merged_by_key(base: DataFrame, changes: DataFrame, key: str, version: list[str], keep: list[str]) -> DataFrame:
    """base with changes upserted by key: of several changes the greatest version holds, and the columns in ``keep``
    come from the base row where there is one. ``action`` says insert, update or keep. Null keys are left out."""
    cols = [c for c in base.columns if c != key]
    newest = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*version, *[c for c in cols if c not in version])).alias("n"))
    t = base.where(F.col(key).isNotNull()).select(key, F.struct(*cols).alias("o")).join(newest, key, "full")
    out = [F.when(F.col("n").isNull() | (F.lit(c in keep) & F.col("o").isNotNull()), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in cols]
    action = F.when(F.col("n").isNull(), "keep").when(F.col("o").isNull(), "insert").otherwise("update")
    return t.select(key, *out, action.alias("action"))


def unprocessed(items: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key is not in the ledger; a null key never is."""
    return items.join(ledger.select(*keys).distinct(), keys, "left_anti")


def removed(records: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """records without the rows whose key is in ``gone``; null keys there remove nothing."""
    return records.join(gone.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def unique_ids(made: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """made (base, ...) with ``unique_id``: the base for the first row in ``order``, then base-2, base-3, ..., without ids in ``taken``.

    ``taken``: (taken) ids with or without such a suffix. The k-th new row of a base gets the k-th free number; a row
    number is a running total, so a base with very many rows is spread over tasks. ``order`` must end in an id.
    """
    ranked = running_totals(made, ["base"], order, {"_before": "1"})
    held = taken.where(F.col("taken").isNotNull()).select(F.when(F.col("taken").rlike(r"-\d+$"), F.regexp_extract("taken", r"^(.*)-(\d+)$", 1)).otherwise(F.col("taken")).alias("base"), F.expr("try_cast(nullif(regexp_extract(taken, '^(.*)-([0-9]+)$', 2), '') AS bigint)").alias("n"))
    held = held.select("base", F.coalesce("n", F.lit(1)).alias("n")).where("n > 0").distinct()
    held = running_totals(held, ["base"], ["n"], {"_lower": "1"}).select("base", (F.col("n") - F.col("_lower") - 1).alias("_free"))  # free numbers below it
    by_free = held.groupBy("base", "_free").agg(F.count("*").alias("_c"))
    up = ranked.select("base", "_before").join(by_free, "base").where(F.col("_free") <= F.col("_before")).groupBy("base", "_before").agg(F.sum("_c").alias("_up"))
    slot = F.col("_before") + 1 + F.coalesce("_up", F.lit(0))
    t = ranked.join(up, ["base", "_before"], "left")
    return t.select(*made.columns, F.when(slot == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), slot.cast("string"))).alias("unique_id"))


def catalog_lines(records: DataFrame) -> DataFrame:
    """(section, place, id, line): active and candidate records in a section for each project, by type, falling confidence and
    id; those in quarantine in one section by id. Of repeated ids the greatest row counts. Records without a project are in no project's section."""
    one = records.groupBy("id").agg(F.max(F.struct("status", "project", "type", "title", "confidence")).alias("r")).select("id", "r.*")
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.regexp_replace(F.col("confidence").cast("string"), r"\.0$", "")
    live = one.where(F.col("status").isin("active", "candidate") & F.col("project").isNotNull())
    line = F.concat(F.lit("- ["), said("title"), F.lit("](memories/"), "project", F.lit("/"), "id", F.lit(".md) — "), "type", F.lit(", confidence "), number, F.lit(", "), "status")
    live = live.select(F.concat(F.lit("project "), "project").alias("section"), "id", line.alias("line"), "type", (-F.coalesce("confidence", F.lit(-1.0))).alias("falling"))
    held = one.where("status = 'quarantined'").select(F.lit("quarantine").alias("section"), "id", F.concat(F.lit("- "), "id", F.lit(": "), said("title")).alias("line"), F.lit("").alias("type"), F.lit(0.0).alias("falling"))
    return running_totals(live.unionByName(held), ["section"], ["type", "falling", "id"], {"place": "1"}).select("section", "place", "id", "line")


def catalog(records: DataFrame) -> DataFrame:
    """(id, project, type, place): the place of each record in its project, by type, falling confidence and id."""
    t = records.select("id", "project", "type", "confidence").withColumn("falling", -F.coalesce("confidence", F.lit(-1.0)))
    return running_totals(t, ["project"], ["type", "falling", "id"], {"place": "1"}).select("id", "project", "type", "place")


def _matches(types: tuple[str, ...], keywords: tuple[str, ...], low: Column) -> Column:
    """Whether an item is of one of the types (any, if none are given) and its lower-case text has all keywords."""
    ok = F.col("type").isin(*types) if types else F.lit(True)
    for k in keywords:
        ok = ok & F.contains(low, F.lit(k.lower()))
    return F.coalesce(ok, F.lit(False))


def rule_hits(items: DataFrame, rules: list[tuple[str, tuple[str, ...], tuple[str, ...], int]], text: Column) -> DataFrame:
    """(rule, hits, met): for rules (name, types, keywords, least) the items of one of the types whose text has all keywords.

    The rules become columns of one aggregation over the items, not rows of a cross join.
    """
    low = F.lower(text)
    counts = items.agg(*[F.sum(_matches(t, k, low).cast("long")).alias(name) for name, t, k, _ in rules])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("hits"), F.lit(least).alias("least")) for n, _, _, least in rules]))
    t = counts.select(rows.alias("r")).select("r.*")
    return t.select("rule", "hits", (F.col("hits") >= F.col("least")).alias("met"))


def case_scores(items: DataFrame, run: list[str], cases: list[tuple], text: Column) -> DataFrame:
    """(run columns, case, met, expected, forbidden, extras, total, passed) for each case and run, in one aggregation.

    A case: name, rules to meet (types, keywords, least), rules that must not be met, the most extras (items that meet none of
    the case's rules) and the most items, None for any number. A run without items has no row.
    """
    low, sums = F.lower(text), []
    for i, (_, expect, forbid, _, _) in enumerate(cases):
        for kind, rules in (("e", expect), ("f", forbid)):
            sums += [F.sum(_matches(t, k, low).cast("long")).alias(f"_{kind}{i}_{j}") for j, (t, k, _) in enumerate(rules)]
        any_ = functools.reduce(lambda a, b: a | b, [_matches(t, k, low) for t, k, _ in expect], F.lit(False))
        sums.append(F.sum((~any_).cast("long")).alias(f"_x{i}"))
    g = items.groupBy(*run).agg(F.count("*").alias("total"), *sums)
    rows = []
    for i, (name, expect, forbid, extra, most) in enumerate(cases):
        met = functools.reduce(lambda a, b: a + b, [(F.col(f"_e{i}_{j}") >= n).cast("long") for j, (_, _, n) in enumerate(expect)], F.lit(0).cast("long"))
        bad = functools.reduce(lambda a, b: a + b, [F.col(f"_f{i}_{j}") for j in range(len(forbid))], F.lit(0).cast("long"))
        ok = (met == len(expect)) & (bad == 0) & (F.lit(True) if extra is None else F.col(f"_x{i}") <= extra) & (F.lit(True) if most is None else F.col("total") <= most)
        rows.append(F.struct(F.lit(name).alias("case"), met.alias("met"), F.lit(len(expect)).cast("long").alias("expected"), bad.alias("forbidden"), F.col(f"_x{i}").alias("extras"), ok.alias("passed")))
    return g.select(*run, "total", F.explode(F.array(*rows)).alias("r")).select(*run, "r.*", "total")
