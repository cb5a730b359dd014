"""Ids with check digits: the next free ones of many grids or fields at once.

A suffix is decimal digits that all differ; suffixes are given in ascending order.  What a
grid or field has used is gathered beside it (no more than there are suffixes), so the
requests of a whole table are one grouping and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.expressions import check_digit, valid_field_id, valid_project_id, valid_zone_id


def _suffixes(digits: int) -> Column:
    """All suffixes of so many different digits, in order, from a rule."""
    every = F.transform(F.sequence(F.lit(0), F.lit(10**digits - 1)), lambda n: F.lpad(n.cast("string"), digits, "0"))
    return F.filter(every, lambda s: F.size(F.array_distinct(F.split(s, ""))) == digits)


def _next(requests: DataFrame, key: str, used: DataFrame, every: Column) -> DataFrame:
    """(key, suffix): for each request (key, total) so many of ``every`` that ``used`` (key, suffix) does not hold.

    Requests of one key count together.  A request beyond what is left is an error.
    """
    wanted = requests.groupBy(key).agg(F.sum("total").cast("int").alias("total"))
    taken = used.groupBy(key).agg(F.collect_set("suffix").alias("taken"))  # no more than there are suffixes
    free = F.array_except(every, F.coalesce("taken", F.array().cast("array<string>")))
    found = wanted.join(taken, key, "left").withColumn("free", free)
    short = F.raise_error(F.concat(F.lit("no suffix is left for "), F.col(key)))
    given = F.when(F.size("free") < F.col("total"), short.cast("array<string>")).otherwise(F.slice("free", F.lit(1), F.col("total")))
    return found.where("total > 0").select(key, F.explode(given).alias("suffix"))


def _raw(column: Column) -> Column:
    return F.replace(F.upper(F.trim(column)), F.lit("-"))


def next_field_ids(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(grid, field_id) for requests (grid, total); ``existing`` has a column field_id, of which invalid ones do not count."""
    raw = _raw(F.col("field_id"))
    used = existing.where(valid_field_id(F.col("field_id"))).select(F.substring(raw, 2, 2).alias("grid"), F.substring(raw, 4, 4).alias("suffix"))
    found = _next(requests.withColumn("grid", F.upper("grid")), "grid", used, _suffixes(4))
    made = F.concat(F.lit("F-"), "grid", F.lit("-"), "suffix", F.lit("-"), check_digit(F.concat("grid", "suffix")))
    return found.select("grid", made.alias("field_id"))


def _fields(requests: DataFrame) -> DataFrame:
    sound = F.when(valid_field_id(F.col("field_id")), F.substring(_raw(F.col("field_id")), 2, 7)).otherwise(F.raise_error(F.concat(F.lit("no field id: "), F.col("field_id"))).cast("string"))
    return requests.select(sound.alias("field"), "total")


def next_project_ids(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(field_id, project_id) for requests (field_id, total): numbers from 01 to 99 that ``existing`` (project_id) leaves free."""
    raw = _raw(F.col("project_id"))
    used = existing.where(valid_project_id(F.col("project_id"))).select(F.substring(raw, 2, 7).alias("field"), F.substring(raw, 9, 2).alias("suffix"))
    every = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda n: F.lpad(n.cast("string"), 2, "0"))
    found = _next(_fields(requests), "field", used, every)
    return found.select(field_id("field").alias("field_id"), F.concat(F.lit("P-"), "field", F.lit("-"), "suffix").alias("project_id"))


def next_zone_ids(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(field_id, zone_id) for requests (field_id, total); ``existing`` has a column zone_id."""
    raw = _raw(F.col("zone_id"))
    used = existing.where(valid_zone_id(F.col("zone_id"))).select(F.substring(raw, 2, 7).alias("field"), F.substring(raw, 9, 3).alias("suffix"))
    found = _next(_fields(requests), "field", used, _suffixes(3))
    made = F.concat(F.lit("Z-"), "field", F.lit("-"), "suffix", F.lit("-"), check_digit(F.concat("field", "suffix")))
    return found.select(field_id("field").alias("field_id"), made.alias("zone_id"))


def field_id(field: str) -> Column:
    """F-GG-SSSS-C from its seven characters."""
    c = F.col(field)
    return F.concat(F.lit("F-"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 4), F.lit("-"), F.substring(c, 7, 1))
