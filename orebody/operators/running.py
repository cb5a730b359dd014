"""Running numbers and sums over a whole table, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.sources.scratch import settle


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over as many tasks as shuffles have: for what makes many rows of each, where a small file would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or df.columns))


def running(df: DataFrame, order: list[Column], sums: tuple[str, ...] = (), number: str = "number") -> DataFrame:
    """``df`` with its row number from 0, and for each of ``sums`` a ``{name}_before`` over the rows before, in ``order``.

    Rows are dealt out by ranges of the order and numbered within a range; what stands
    before a range is one row for each partition.  ``order`` must tell all rows apart.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranges = settle(ranges, "ranges")
    totals = ranges.groupBy("__range").agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__{c}") for c in sums])
    # a row for each partition
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = totals.select("__range", F.coalesce(F.sum("__rows").over(ahead), zero).alias("__first"), *[F.coalesce(F.sum(f"__{c}").over(ahead), zero).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("__own", F.row_number().over(inside) - 1)
    for c in sums:
        placed = placed.withColumn(f"__own_{c}", F.coalesce(F.sum(c).over(before), zero))
    joined = placed.join(F.broadcast(totals), "__range")
    found = [F.col(c) for c in df.columns] + [(F.col("__first") + F.col("__own")).alias(number)]
    return joined.select(*found, *[(F.col(f"__{c}") + F.col(f"__own_{c}")).alias(f"{c}_before") for c in sums])
