"""Questions over snapshots and series: levels, years, peaks, ends, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.vocabulary import CLASSES, uncertainty
from orebody.sources.scratch import settle


def level_sum(column: str, name: str, level: str = "uncert_level") -> Column:
    """Sum of a volume at an uncertainty level, or the difference of two levels' sums."""
    spec = uncertainty(name)
    if spec.reserves_only and not column.startswith("res_"):
        raise ValueError(f"{name} is defined for reserves, not for {column}")

    def at(value: str) -> Column:
        return F.sum(F.when(F.col(level) == value, F.col(column)))

    return at(spec.level) if spec.less is None else at(spec.level) - at(spec.less)


def latest_year(df: DataFrame, as_of: int, entity: list[str] | None = None, year: str = "report_year") -> DataFrame:
    """Rows of the latest year on or before ``as_of``, for each entity where one is named.

    The latest years are one aggregated row for each entity; rows come back by a semi-join.
    """
    within = df.where(F.col(year) <= as_of)
    last = within.groupBy(*(entity or [])).agg(F.max(year).alias(year))
    return within.join(last, [*(entity or []), year], "left_semi")


def entity_total(df: DataFrame, entity_column: str, entity: str, columns: list[str], name: str = "2P", as_of: int | None = None) -> DataFrame:
    """Totals of one entity at a level, in its latest year."""
    own = df.where(F.col(entity_column).contains(entity))
    if as_of is not None:
        own = latest_year(own, as_of)
    return own.agg(*[level_sum(c, name).alias(c) for c in columns])


def peak_year(df: DataFrame, keys: list[str], value: str, year: str = "year") -> DataFrame:
    """The year of the largest value of each key; the first of equal ones."""
    best = F.max(F.struct(F.col(value).alias("value"), (-F.col(year)).alias("back")))
    return df.groupBy(*keys).agg(best.alias("best")).select(*keys, (-F.col("best.back")).alias("peak_year"), F.col("best.value").alias("peak_value"))


def end_of_life(df: DataFrame, keys: list[str], oil: str, gas: str, year: str = "year") -> DataFrame:
    """The last year with production."""
    return df.groupBy(*keys).agg(F.max(F.when((F.col(oil) > 0) | (F.col(gas) > 0), F.col(year))).alias("eol_year"))


def onstream(df: DataFrame, keys: list[str], oil: str, gas: str, known: str | None = None, year: str = "year") -> DataFrame:
    """The known first year, else the first one with production."""
    first = F.min(F.when((F.col(oil) > 0) | (F.col(gas) > 0), F.col(year)))
    return df.groupBy(*keys).agg((F.coalesce(F.min(known), first) if known else first).alias("onstream_year"))


def trend(df: DataFrame, keys: list[str], value: str, first: int, last: int, year: str = "year") -> DataFrame:
    return df.where(F.col(year).between(first, last)).groupBy(*keys, year).agg(F.sum(value).alias(value))


def compare_years(df: DataFrame, keys: list[str], value: str, years: tuple[int, int], year: str = "report_year") -> DataFrame:
    """One column for each year; the years are given, so there is no pass to find them."""
    return df.where(F.col(year).isin(*years)).groupBy(*keys).agg(*[F.sum(F.when(F.col(year) == y, F.col(value))).alias(f"y{y}") for y in years])


def potential(df: DataFrame, recoverable: str, reserves: str, name: str = "potential") -> DataFrame:
    """What is recoverable beyond the reserves."""
    return df.withColumn(name, F.col(recoverable) - F.col(reserves))


def concept_total(df: DataFrame, columns: tuple[str, str], place: tuple[str, str] | None = None, level: str | None = None, kind: str | None = None, year: str = "report_year") -> DataFrame:
    """(oil_condensate, gas) of the latest year: the sums of a concept's two columns.

    place: a column and a part of its text; level: ``1P`` .. ``3U`` or a name of one;
    kind: a word for a project class.
    """
    rows = df.where(F.col(year) == df.agg(F.max(year).alias("y")).first()["y"])  # one row
    if place is not None:
        rows = rows.where(F.col(place[0]).contains(place[1]))
    if level is not None:
        rows = rows.where(F.col("uncert_level") == uncertainty(level).level)
    if kind is not None:
        rows = rows.where(F.col("project_class") == CLASSES[kind.lower()])
    return rows.agg(F.sum(columns[0]).alias("oil_condensate"), F.sum(columns[1]).alias("gas"))


def top(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n largest keys by the sum of a value; equal ones by key."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value)).orderBy(F.col(value).desc(), *keys).limit(n)


#: A key with more than this share of all rows is cut into ranges of time, of about as many rows each.
HOT_SHARE, TIME_RANGES = 1 / 256, 64


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row at or before its time, without a range join.

    A key is a group, and one that holds much of the table is as many groups as it has ranges
    of time: ranges are cut by quantiles of its own times, so that a burst is spread.  What a
    range begins with is the last value of the ranges before it, one row for each key and range.
    """

    def number(column: str) -> Column:
        return F.col(column).cast("timestamp").cast("double") if "timestamp" in dict(left.dtypes).get(left_time, "") else F.col(column).cast("double")

    def same(own: list[str]) -> Column:
        return F.expr(" AND ".join(f"`{k}` <=> `__{k}_`" for k in own))

    known = right.select(*keys, F.col(right_time).alias("__t"), number(right_time).alias("__at"), F.col(value).alias("__v")).where("__at IS NOT NULL")
    asked = left.withColumn("__at", number(left_time))
    rows = known.select(*keys, "__at").unionByName(asked.select(*keys, "__at"))
    counts = settle(rows.groupBy(*keys).agg(F.count("*").alias("__n")), "key-counts")
    total = counts.agg(F.sum("__n").alias("n")).first()["n"] or 0
    # no more keys than 1 / HOT_SHARE
    hot = counts.where(F.col("__n") > total * HOT_SHARE).select(*[F.col(k).alias(f"__{k}_") for k in keys])
    cut = not hot.isEmpty()
    if cut:
        quantiles = [F.lit(k / TIME_RANGES) for k in range(1, TIME_RANGES)]
        ends = rows.join(F.broadcast(hot), same(keys)).groupBy(*hot.columns).agg(F.array_distinct(F.percentile_approx("__at", F.array(*quantiles), 1000)).alias("__ends"))
        ends = F.broadcast(settle(ends, "time-ranges"))
        part = F.greatest(F.size(F.filter("__ends", lambda e: e <= F.col("__at"))), F.lit(0))
        known = known.join(ends, same(keys), "left").withColumn("__part", part).drop(*ends.columns)
        asked = asked.join(ends, same(keys), "left").withColumn("__part", part).drop(*ends.columns)
    else:
        known, asked = (side.withColumn("__part", F.lit(0)) for side in (known, asked))
    both = asked.withColumn("__t", F.col(left_time)).withColumn("__v", F.lit(None)).withColumn("__left", F.lit(True)).unionByName(known.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*keys, "__part").orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.last("__v", ignorenulls=True).over(before)).where("__left")
    if not cut:
        return found.select(*left.columns, F.when(F.col("__at").isNotNull(), F.col("__own")).alias(value))
    # the last value of a range, and what each later range with rows begins with
    last = known.where("__v IS NOT NULL").groupBy(*keys, "__part").agg(F.max_by("__v", "__t").alias("__carry"))
    slots = last.unionByName(asked.select(*keys, "__part").distinct().withColumn("__carry", F.lit(None)))
    earlier = Window.partitionBy(*keys).orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("__before", F.last("__carry", ignorenulls=True).over(earlier)).groupBy(*keys, "__part").agg(F.first("__before").alias("__before"))
    renamed = carried.select(*[F.col(k).alias(f"__{k}_") for k in (*keys, "__part")], "__before")
    joined = found.join(renamed, same([*keys, "__part"]), "left")
    return joined.select(*left.columns, F.when(F.col("__at").isNotNull(), F.coalesce("__own", "__before")).alias(value))
