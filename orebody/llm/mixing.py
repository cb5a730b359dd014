"""Mixing sources to target weights.

Sizes are words per document.  Per-source totals are aggregated once, targets are
filled like water under a ceiling, and every document is emitted ``floor(rate)``
times plus one copy drawn by a Bernoulli trial whose seed is a hash of the id.

Defined results: a null text has size 0 and takes nothing; a null source is a source
of its own and is ordered last; rows that repeat an id are separate documents that
share one draw; an empty table gives an empty result; a source without words has
target 0.  Extra columns are kept by :func:`mix` and ignored by :func:`plan_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.running import running

from .shared import columns, settle

#: Fixed values of the mixing contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET_SHARE = 1.5
CEILING = 2.0
SEED = "mix-1"
#: Source totals up to this many rows are broadcast; beyond, AQE joins them with its skew handling.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a frame with ``source`` and ``size``.

    A common level L gives every source min(ceiling, L * weight).  Sorting by
    ceiling / weight makes the capped sources a prefix, so L follows from running
    sums; no loop over sources, and no task that holds them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], number="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(CEILING)).alias("cap"))
    per = running(per, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], ("cap", "weight"))
    per = settle(per, "mix-sources")
    everything = per.agg((F.sum("source_size") * F.lit(BUDGET_SHARE)).alias("budget"), F.sum("weight").alias("weight_all"))
    # one row beside every source
    per = per.crossJoin(F.broadcast(everything))
    # the level if all sources before this one are capped and this one is not
    per = per.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before")))
    free = F.col("level") * F.col("weight") < F.col("cap")
    final = per.agg(F.min(F.when(free, F.struct("cap_before", "number", "level"))).alias("first")).select(F.col("first.level").alias("final"))
    per = per.crossJoin(F.broadcast(final))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def copies(rate: Column, doc_id: Column) -> Column:
    """floor(rate) plus one copy where the id's hash falls below the fraction."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, n_copies) of every document."""
    docs = columns(docs, doc_id="long", source="string", text="string")
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    goal = targets(sizes).select(F.col("source").alias("goal_source"), "source_size", "target")
    goal = settle(goal, "mix-targets")
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    joined = sizes.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CEILING))).otherwise(0.0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies(rate, F.col("doc_id")).alias("n_copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents themselves, each row repeated as often as the mix takes it."""
    have = {c.lower(): c for c in docs.columns}
    source, text, doc_id = (docs[have[c]] for c in ("source", "text", "doc_id"))
    sizes = settle(docs.select(source.cast("string").alias("source"), word_count(text).alias("size")), "mix-sizes")
    # names that the documents do not have
    own, rate = (next(n for k in range(len(have) + 1) if (n := f"{name}_{k}") not in have) for name in ("goal_source", "goal_rate"))
    goal = targets(sizes).select(
        F.col("source").alias(own),
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CEILING))).otherwise(0.0).alias(rate),
    )
    goal = settle(goal, "mix-targets")
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    joined = docs.join(goal, source.cast("string").eqNullSafe(F.col(own)))
    times = F.array_repeat(F.lit(0), copies(F.col(rate), doc_id).cast("int"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(times).alias(own)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


ORACLE = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sizes GROUP BY source),
ordered AS (
  SELECT *, {CEILING}::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY {CEILING}::DOUBLE * source_size / weight, encode(source) ASC NULLS LAST) AS k FROM per),
lvl AS (
  SELECT *, ((SELECT {BUDGET_SHARE}::DOUBLE * SUM(source_size)::DOUBLE FROM per) - COALESCE(SUM(cap) OVER w, 0))
          / ((SELECT SUM(weight) FROM per) - COALESCE(SUM(weight) OVER w, 0)) AS level
  FROM ordered WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM lvl WHERE level * weight < cap ORDER BY k LIMIT 1),
goal AS (
  SELECT source, source_size, COALESCE(LEAST(cap, (SELECT level FROM final) * weight), cap) AS target FROM lvl),
rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN LEAST(g.target / g.source_size, {CEILING}::DOUBLE) ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || COALESCE(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {16**13}::DOUBLE AS draw
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
