"""Mixing sources to target weights (problem 7).

Each source's documents are put in an order given by a hash, once for each time the source is used, and cut by a
running total into blocks of equal tokens. The mixture has slots; slot k belongs to the source into whose stretch
of the cumulative weights the point frac((k + 1) * golden ratio) falls. These points spread evenly, so every
stretch of the mixture has nearly the target shares. The j-th slot of a source takes its j-th block.

The last use of a source is seldom due as a whole. Its documents are taken in order as long as they fit what is due;
what then remains is offered to the later documents that are small enough, and so on, until it is a five-hundredth
of the source's share or no document fits. A last document is taken above the share if that is nearer to it.

Running totals and ranks are taken over range-partitioned stretches, so a source with a third of all rows is no
single task.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.tokens import TOKENIZER, sizes
from sessionloom.operators.runs import running_totals
from sessionloom.runtime import Scratch, table

BLOCK_TOKENS = 2048
#: The golden ratio's fractional part.
STEP = (math.sqrt(5) - 1) / 2


def source_key(c: str | Column) -> Column:
    """Sources in one spelling: trimmed, lower case, hyphens and blanks as underscores."""
    t = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(t, r"[\s-]+", "_")


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], shortfall: float = 0.0) -> tuple[float, dict[str, float]]:
    """(tokens of the mixture, tokens of each source).

    The mixture is the largest in which every source that has documents reaches its share without passing its cap;
    the share of sources without documents falls to the others in proportion. With ``shortfall`` sources whose
    shares together are at most that much may stay below their share, with all their repeats used.
    """
    has = {s: (w, max(0, r) * totals[s]) for s, w, r in targets if totals.get(s, 0) > 0 and w > 0 and r > 0}
    weight = sum(w for w, _ in has.values())
    if not has:
        return 0.0, {}
    short, missed = set(), 0.0
    for s in sorted(has, key=lambda s: has[s][1] / has[s][0]):
        if missed + has[s][0] / weight > shortfall + 1e-12 or len(short) + 1 == len(has):
            break
        short.add(s)
        missed += has[s][0] / weight
    total = min(has[s][1] / (has[s][0] / weight) for s in has if s not in short)
    give = {s: min(has[s][1], total * has[s][0] / weight) for s in has}
    return sum(give.values()), give


def _due(sized: DataFrame, due: dict[str, float], scratch: Scratch) -> DataFrame | None:
    """(row, doc_id, source, tokens, before): documents of at most ``due`` tokens of each source, as near to it as they come."""
    goal, done, taken, step = dict(due), dict.fromkeys(due, 0), [], 0
    left = sized.withColumn("h", F.xxhash64("doc_id", "row"))
    while live := [s for s in due if goal[s] - done[s] > 0.002 * goal[s]]:
        room = {s: goal[s] - done[s] for s in live}
        left = left.where(F.col("source").isin(live))
        fits = left.where(F.col("tokens") <= _lookup(room, "source", 0.0))
        ordered = running_totals(fits, ["source"], ["h", "doc_id"], {"before": "tokens"}, scratch=scratch.part(f"round{step}"))
        now = scratch.keep(ordered.where(F.col("before") + F.col("tokens") <= _lookup(room, "source", 0.0)).withColumn("before", F.col("before") + _lookup(done, "source", 0)).drop("h"), f"taken{step}")
        got = {r.source: r.t for r in now.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row for each target
        taken.append(now)
        left, step = left.join(now.select("row"), "row", "left_anti"), step + 1
        due = {s: due[s] for s in got}
        for s in got:
            done[s] += got[s]
    # Of the documents that no longer fit, the smallest may be nearer to the share than none.
    short = {s: goal[s] - done[s] for s in goal if goal[s] > done[s]}
    if short:
        rest = sized if not taken else sized.join(functools.reduce(DataFrame.unionByName, taken).select("row"), "row", "left_anti")
        rest = rest.where(F.col("source").isin(list(short)) & (F.col("tokens") < 2 * _lookup(short, "source", 0.0)))
        least = rest.groupBy("source").agg(F.min(F.struct("tokens", "doc_id", "row")).alias("m"))
        taken.append(least.select("m.row", "m.doc_id", "source", "m.tokens", _lookup(done, "source", 0).cast("long").alias("before")))
    return functools.reduce(DataFrame.unionByName, taken) if taken else None


def _lookup(values: dict[str, float], c: str, none: float) -> Column:
    return functools.reduce(lambda x, s: F.when(F.col(c) == s, values[s]).otherwise(x), values, F.lit(none))


def mixture(docs: DataFrame, targets: list[tuple[str, float, int]], block: int = BLOCK_TOKENS, shortfall: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(rows, shares) from docs (doc_id, source, tokens) and targets (source, share, greatest number of uses).

    rows: ``slot``, ``source``, ``use`` (0 for the first), ``doc_id``, ``tokens``, ``start`` (tokens of the source
    before it); the mixture is read by slot, then start. shares: a row for each target with the tokens there are,
    those used, target and reached share, and the most uses of a document. Documents of no target, without a source
    or without tokens are not in a mixture. Of repeated targets the one with the greatest values counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixture")
    targets = list({t[0]: t for t in sorted(targets)}.values())
    sized = docs.where((F.col("tokens") > 0) & F.col("source").isin([t[0] for t in targets]))
    sized = scratch.keep(sized.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "tokens"), "sized")
    totals = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row for each target
    total, give = plan(totals, targets, shortfall)
    whole = {s: math.floor(give[s] / totals[s] + 1e-9) for s in give}
    used = sized.where(F.col("source").isin([s for s in give if whole[s]])).withColumn("use", F.explode(F.sequence(F.lit(0), _lookup(whole, "source", 1).cast("int") - 1)))
    used = used.withColumn("h", F.xxhash64("doc_id", "use"))
    ordered = running_totals(used, ["source", "use"], ["h", "doc_id"], {"start": "tokens"}, scratch=scratch)
    ordered = ordered.select("source", "use", "doc_id", "tokens", (F.col("start") + F.col("use") * _lookup(totals, "source", 0)).alias("start"))
    due = {s: give[s] - whole[s] * totals[s] for s in give}
    last = _due(sized, {s: d for s, d in due.items() if d > 0.5}, scratch)
    if last is not None:
        start = F.col("before") + _lookup({s: whole[s] * totals[s] for s in give}, "source", 0)
        ordered = ordered.unionByName(last.select("source", _lookup(whole, "source", 0).cast("int").alias("use"), "doc_id", "tokens", start.alias("start")))
    ordered = ordered.withColumn("block", F.floor(F.col("start") / block))

    slots = math.ceil(total / block)
    point = F.pmod((F.col("id") + 1) * F.lit(STEP), F.lit(1.0))
    names, edges = sorted(give), []
    for s in names:
        edges.append((edges[-1] if edges else 0.0) + give[s] / total)
    chosen = F.lit(names[-1] if names else None).cast("string")
    for s, e in reversed(list(zip(names, edges, strict=True))[:-1]):
        chosen = F.when(point < e, s).otherwise(chosen)
    schedule = spark.range(slots).select(F.col("id").alias("slot"), chosen.alias("source"))
    ranked = running_totals(schedule, ["source"], ["slot"], {"block": "1"}, scratch=Scratch(spark, "slots"))
    rows = ordered.join(ranked, ["source", "block"], "left")
    # A source may have a block or two more than slots; these come at the end.
    rows = rows.select(F.coalesce("slot", F.col("block") + slots).cast("long").alias("slot"), "source", F.col("use").cast("long").alias("use"), "doc_id", "tokens", F.col("start").cast("long").alias("start"))
    reached = ordered.groupBy("source").agg(F.sum("tokens").alias("used"), F.max(F.col("use") + 1).cast("long").alias("most_uses"))
    table_ = [(s, float(w), int(r), int(totals.get(s, 0))) for s, w, r in targets]
    shares = spark.createDataFrame(table_, "source string, target_share double, max_repeats long, available long").join(reached, "source", "left")
    sum_ = reached.agg(F.sum("used").alias("all"))
    shares = shares.join(F.broadcast(sum_), F.lit(True))  # one row
    return rows, shares.select("source", "target_share", "max_repeats", "available", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce(F.col("used") / F.col("all"), F.lit(0.0)).alias("reached_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))


#: Weight of the scarcest sources that may stay below their share (with all their repeats used) in the registered mixture.
SHORTFALL = 0.02


def _mix(spark: SparkSession, sf_dir: str, shortfall: float = 0.0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", source_key("source").alias("source"), sizes(F.col("text"), tokenizer)["tokens"].alias("tokens"))
    rows = table(spark, sf_dir, "mix_targets").select(source_key("source").alias("source"), "target_share", "max_repeats").dropna().collect()  # a fixed table
    return mixture(docs, [tuple(r) for r in rows], shortfall=shortfall)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in which only the scarcest sources, ``SHORTFALL`` of the weight together, may stay below their share."""
    return _mix(spark, sf_dir, SHORTFALL)[0]


def p7_mixture_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``p7_mixture``, under its earlier name."""
    return p7_mixture(spark, sf_dir)


def p7_mixture_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in which every source that has documents reaches its share; the scarcest decides its size."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source reaches, in ``p7_mixture`` and in ``p7_mixture_strict``."""
    both = [_mix(spark, sf_dir, x)[1].select(F.lit(n).alias("mixture"), "*") for n, x in (("default", SHORTFALL), ("strict", 0.0))]
    return both[0].unionByName(both[1])


QUERIES = {f.__name__: f for f in (p7_mixture, p7_shares, p7_mixture_large, p7_mixture_strict)}
ORACLE: dict[str, str] = {}
