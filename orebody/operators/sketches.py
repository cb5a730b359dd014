"""Distinct counts and quantiles by sketches that are kept for each group and merged up the hierarchy.

The base is read once, for the finest level; every level above merges the sketches below it.
Distinct values are HyperLogLog sketches of 2**``LG_K`` registers, whose estimate has a
relative standard error of 1.04 / sqrt(2**LG_K).  Quantiles are counts of values by buckets
whose ends grow by (1 + a) / (1 - a): every quantile is within ``ACCURACY`` = a of an exact one,
relatively, and two sketches add up to the sketch of both, exactly.  A bucket is kept where it
has a value, so a sketch has no more buckets than the values' range asks.

Null and NaN values count nowhere; a group without values estimates 0 distinct ones and has null quantiles.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.sources.scratch import settle

LG_K = 12
ACCURACY = 0.005
GROWTH = (1 + ACCURACY) / (1 - ACCURACY)


def distinct_error(deviations: float = 3.0) -> float:
    """The relative error of a distinct count that so many standard deviations allow."""
    return deviations * 1.04 / sqrt(2**LG_K)


def bucket(value: Column) -> Column:
    """The number of a value's bucket: sign, and the power of GROWTH at or above its size; 0 is a bucket of its own."""
    size = F.ceil(F.log(F.abs(value)) / F.lit(log(GROWTH)))
    # numbers of either sign are apart and in the order of the values
    return F.when(value == 0, F.lit(0)).when(value > 0, size + (1 << 20)).otherwise(-(size + (1 << 20))).cast("int")


def bucket_value(number: Column) -> Column:
    """The middle of a bucket, within ACCURACY of all its values."""
    power = F.abs(number) - (1 << 20)
    middle = F.exp(power * F.lit(log(GROWTH))) * F.lit(2 / (1 + GROWTH))
    return F.when(number == 0, 0.0).when(number > 0, middle).otherwise(-middle)


def distinct_levels(base: DataFrame, value: str, levels: list[tuple[str, ...]]) -> list[DataFrame]:
    """Each level's (keys, sketch), the first from the base and every other from the one before it."""
    own = base.groupBy(*levels[0]).agg(F.hll_sketch_agg(F.col(value), F.lit(LG_K)).alias("sketch"))
    out = [settle(own, "distinct-0")]
    for k, keys in enumerate(levels[1:], 1):
        out.append(settle(out[-1].groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch")), f"distinct-{k}"))
    return out


def distinct_estimates(level: DataFrame) -> DataFrame:
    return level.select(*[c for c in level.columns if c != "sketch"], F.hll_sketch_estimate("sketch").alias("distinct"))


def quantile_levels(base: DataFrame, value: str, levels: list[tuple[str, ...]]) -> list[DataFrame]:
    """Each level's (keys, bucket, n), the first from the base and every other from the one before it."""
    v = F.col(value).cast("double")
    own = base.select(*levels[0], F.when(v.isNotNull() & ~F.isnan(v), bucket(v)).alias("bucket")).groupBy(*levels[0], "bucket").agg(F.count("bucket").alias("n"))
    out = [settle(own, "quantiles-0")]
    for k, keys in enumerate(levels[1:], 1):
        out.append(settle(out[-1].groupBy(*keys, "bucket").agg(F.sum("n").alias("n")), f"quantiles-{k}"))
    return out


def quantile_estimates(level: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(keys, a column for each quantile): a value of rank floor(q * (n - 1)) from 0, within ACCURACY."""
    keys = [c for c in level.columns if c not in ("bucket", "n")]
    # a group has a row for each of its buckets
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upto = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = level.withColumns({"upto": upto, "all": F.sum("n").over(own)})
    found = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("bucket"))).alias(name) for name, q in quantiles.items()]
    picked = rows.groupBy(*keys).agg(*found)
    return picked.select(*keys, *[bucket_value(F.col(name)).alias(name) for name in quantiles])
