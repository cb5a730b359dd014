"""Answers from the coarsest stored level that holds them.

A level is the base grouped by some keys, with the sum, the count, the least and the greatest
of each measure.  A request is covered by a level that has its keys, the columns of its
filters and its measures; of the levels that cover it the one of the fewest rows answers, and
where none does the base.  Sums, counts and extremes of a level add up; an average is the
sum of sums over the sum of counts; distinct values never add up, so the base counts them.
Requests that share a level and keys are answered by one scan of it.

Levels are built from the smallest level that covers them, so a coarse level does not read
the base.  A group is answered where some row passes the filters; a measure without values
gives null, as in SQL; null keys are values of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.sources.scratch import settle

#: What can be asked of a measure, and of rows.
KINDS = ("sum", "avg", "min", "max", "count", "rows", "distinct")
TESTS = ("=", "in", "between", "null")


@dataclass(frozen=True)
class Filter:
    column: str
    test: str
    values: tuple = ()

    def condition(self) -> Column:
        own = F.col(self.column)
        if self.test == "=":
            return own == F.lit(self.values[0])
        if self.test == "in":
            return own.isin(*self.values)
        if self.test == "between":
            return own.between(*self.values)
        if self.test == "null":
            return own.isNull()
        raise ValueError(f"no test {self.test!r}: {', '.join(TESTS)}")


@dataclass(frozen=True)
class Request:
    name: str
    keys: tuple[str, ...]
    kind: str
    measure: str | None = None
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Stored:
    name: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    rows: int
    table: DataFrame
    is_base: bool = False

    def covers(self, request: Request) -> bool:
        """Whether this level's rows say all that the request asks."""
        if request.kind not in KINDS:
            raise ValueError(f"no such kind: {request.kind!r}")
        needed = {*request.keys, *(f.column for f in request.filters)}
        if self.is_base:
            needed |= {request.measure} if request.measure else set()
            return needed <= set(self.table.columns)
        return request.kind != "distinct" and needed <= set(self.keys) and (request.measure is None or request.measure in self.measures)

    def value(self, kind: str, measure: str | None, chosen: Column) -> Column:
        """The aggregate of a request over the rows that pass its filters."""

        def of(column: str) -> Column:
            return F.when(chosen, F.col(column))

        if self.is_base:
            if kind == "rows":
                return F.count(F.when(chosen, 1))
            own = of(measure)
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "distinct": F.countDistinct}[kind](own)
        if kind == "rows":
            return F.coalesce(F.sum(of("rows")), F.lit(0))
        if kind in ("min", "max"):
            return {"min": F.min, "max": F.max}[kind](of(f"{kind}_{measure}"))
        total, n = F.sum(of(f"sum_{measure}")), F.sum(of(f"n_{measure}"))
        return {"sum": total, "count": F.coalesce(n, F.lit(0)), "avg": F.try_divide(total, n)}[kind]

    def present(self, chosen: Column) -> Column:
        return F.coalesce(F.sum(F.when(chosen, F.lit(1) if self.is_base else F.col("rows"))), F.lit(0)) > 0


def _group(finer: Stored, keys: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    parts = [(F.count("*") if finer.is_base else F.sum("rows")).alias("rows")]
    for m in measures:
        if finer.is_base:
            parts += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
        else:
            parts += [F.sum(f"sum_{m}").alias(f"sum_{m}"), F.sum(f"n_{m}").alias(f"n_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}")]
    return finer.table.groupBy(*keys).agg(*parts)


def build(base: DataFrame, levels: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> list[Stored]:
    """The lattice of a base and named levels (keys, measures), finest first, each written once."""
    held = [Stored("base", tuple(base.columns), (), base.count(), base, True)]
    for name, (keys, measures) in sorted(levels.items(), key=lambda x: (-len(x[1][0]), x[0])):
        finer = min((s for s in held if set(keys) <= set(s.table.columns if s.is_base else s.keys) and (s.is_base or set(measures) <= set(s.measures))), key=lambda s: s.rows)
        table = settle(_group(finer, keys, measures), f"level-{name}")
        held.append(Stored(name, keys, measures, table.count(), table))
    return held


def choose(levels: list[Stored], request: Request) -> Stored:
    """The level of the fewest rows that covers a request; equal ones by name."""
    fit = [s for s in levels if s.covers(request)]
    if not fit:
        raise ValueError(f"{request.name}: no table has {request.keys}, {request.measure} and the filters' columns")
    return min(fit, key=lambda s: (s.rows, s.is_base, s.name))


def answer(levels: list[Stored], requests: list[Request]) -> DataFrame:
    """(request, level, group, value) of all requests; ``group`` is the keys' values joined by ``|``, null as ``null``."""
    if not requests:
        raise ValueError("no request")
    scans: dict[tuple[str, tuple[str, ...]], list[Request]] = {}
    by_name = {s.name: s for s in levels}
    for r in requests:
        scans.setdefault((choose(levels, r).name, r.keys), []).append(r)
    parts = []
    for (name, keys), asked in scans.items():
        level = by_name[name]
        chosen = [reduce(lambda a, b: a & b, [f.condition() for f in r.filters], F.lit(True)) for r in asked]
        # rows that no request of this scan asks for are left in the file
        some = reduce(lambda a, b: a | b, chosen)
        rows = level.table.where(some).groupBy(*keys)
        values = [x for k, (r, c) in enumerate(zip(asked, chosen)) for x in (level.value(r.kind, r.measure, c).cast("double").alias(f"v{k}"), level.present(c).alias(f"p{k}"))]
        label = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
        told = F.array(*[F.struct(F.lit(r.name).alias("request"), F.col(f"v{k}").alias("value"), F.col(f"p{k}").alias("present")) for k, r in enumerate(asked)])
        out = rows.agg(*values).select(label.alias("group"), F.explode(told).alias("r"))
        parts.append(out.where("r.present").select("r.request", F.lit(name).alias("level"), "group", "r.value"))
    return reduce(DataFrame.unionByName, parts)
