"""Rollups that are kept up to date: a change replaces the partitions of its years, and only touched groups climb.

Base rows and every level are tables by report year.  New rows replace those of the same key
in the partitions of their years; no other partition is read or written.  At each level the
groups that changed rows belong to, before or after the change, are computed again from the
level below; the year's other groups stay as they are.  Sums, counts and extremes of a group
come from the stored groups below it, so the base is read once, for the touched groups of the
first level.

A level's groups are found by equality that takes null for a value.  A year that is left
without rows loses its partition.  Every table is written elsewhere first and then put in
place, and a refresh may be repeated: it gives the same levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.rollup import Level, roll_up
from orebody.sources.files import upsert
from orebody.sources.scratch import settle

YEAR = "report_year"
#: Touched groups up to so many are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Rows of a task that groups or writes, about.
DEALT = 500_000
#: Files of a year, at least.
SLICES = 16


def _at(path: str, level: int | None) -> str:
    return f"{path.rstrip('/')}/{'base' if level is None else f'level-{level}'}"


def read(spark: SparkSession, path: str, level: int | None = None, years: list[int] | None = None) -> DataFrame:
    """The base (no level) or a level; years that are asked for alone are scanned."""
    rows = spark.read.parquet(_at(path, level))
    return rows if years is None else rows.where(F.col(YEAR).isin(*years))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows, of which there are ``n`` at most, over more tasks where a core's share is too much for one: groups of texts are sorted."""
    return rows if n <= DEALT * rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(-(-n // DEALT), *rows.columns)


def _replace(rows: DataFrame, path: str, level: int | None, years: list[int] | None) -> None:
    """Put rows in place of the years' partitions (of everything, without years)."""
    rows = settle(rows, "replacement")
    slices = F.lit(max(SLICES, -(-rows.count() // DEALT)))
    writer = rows.repartition(YEAR, F.pmod(F.xxhash64(*rows.columns), slices)).write.mode("overwrite").partitionBy(YEAR)
    if years is None:
        writer.option("partitionOverwriteMode", "static").parquet(_at(path, level))
        return
    writer.option("partitionOverwriteMode", "dynamic").parquet(_at(path, level))
    spark = rows.sparkSession
    # one row a year
    left = {r[YEAR] for r in rows.select(YEAR).distinct().collect()}
    for year in set(years) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{_at(path, level)}/{YEAR}={year}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def load(base: DataFrame, path: str, levels: tuple[Level, ...], orders: tuple[str | None, ...] | None = None) -> None:
    """Write base rows and all levels anew."""
    spark = base.sparkSession
    _replace(base, path, None, None)
    below = read(spark, path)
    for k, level in enumerate(levels):
        _replace(roll_up(_dealt(below, below.count()), level, orders[k] if orders else None), path, k, None)
        below = read(spark, path, k)


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__{c}"]) for c in keys])


def _groups(rows: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    own = settle(rows.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct(), label)
    # a small file may hold a great many groups: its size must not have them broadcast
    return F.broadcast(own) if own.count() <= BROADCAST_GROUPS else own.hint("merge")


def refresh(spark: SparkSession, path: str, levels: tuple[Level, ...], years: list[int], changed: DataFrame, orders: tuple[str | None, ...] | None = None) -> list[int]:
    """Let changed base rows (as they were and as they are) climb; the number of groups computed again at each level."""
    counts: list[int] = []
    below = read(spark, path, None, years)
    for k, level in enumerate(levels):
        touched = _groups(changed, level.keys, f"touched-{k}")
        own = below.join(touched, _same(below, touched, level.keys), "left_semi")
        fresh = settle(roll_up(_dealt(own, below.count()), level, orders[k] if orders else None), f"fresh-{k}")
        before = read(spark, path, k, years)
        kept = before.join(touched, _same(before, touched, level.keys), "left_anti")
        gone = settle(before.join(touched, _same(before, touched, level.keys), "left_semi"), f"gone-{k}")
        # a partition column is read last; columns go by name
        _replace(kept.unionByName(fresh), path, k, years)
        counts.append(fresh.count())
        changed = gone.unionByName(fresh)
        below = read(spark, path, k, years)
    return counts


def _years(rows: DataFrame) -> list[int]:
    # one row a year
    return sorted(r[YEAR] for r in rows.select(YEAR).distinct().collect())


def apply(new: DataFrame, path: str, levels: tuple[Level, ...], keys: list[str], order: list[str], orders: tuple[str | None, ...] | None = None) -> list[int]:
    """New rows replace old ones of the same ``keys`` (the year among them), and all levels follow."""
    spark = new.sparkSession
    if YEAR not in keys:
        raise ValueError(f"{YEAR} must be one of the keys")
    new = settle(new, "new-rows")
    years = _years(new)
    if not years:
        return [0] * len(levels)
    old = read(spark, path, None, years)
    new = new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])
    replaced = settle(old.join(_groups(new, tuple(keys), "new-keys"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]), "left_semi"), "replaced")
    _replace(upsert(old, new, keys, order), path, None, years)
    return refresh(spark, path, levels, years, replaced.unionByName(new), orders)


def replace_years(new: DataFrame, path: str, levels: tuple[Level, ...], years: list[int], orders: tuple[str | None, ...] | None = None) -> list[int]:
    """The rows of these years are these and no others; a year without any goes."""
    spark = new.sparkSession
    old = settle(read(spark, path, None, years), "old-years")
    new = settle(new.where(F.col(YEAR).isin(*years)).select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns]), "new-years")
    _replace(new, path, None, years)
    return refresh(spark, path, levels, years, old.unionByName(new), orders)
