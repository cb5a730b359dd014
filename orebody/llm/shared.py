"""Helpers shared by the training-data operators: tables, scratch, projections."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.sources.scratch import scratch, settle

__all__ = ["HOT_KEYS", "ROW", "batch_rows", "columns", "scratch", "settle", "spread_join", "table"]

#: A key with more than this share of all rows is dealt over several tasks; there are no more such keys than its inverse.
HOT_KEYS = 1024
#: What a row is known by: its id, and a hash of id and text for rows that repeat an id.
ROW = ["doc", "row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns of any name fall away.

    A missing column reads as null, so that an operator has a defined result
    on a table without it.
    """
    have = {c.lower(): c for c in df.columns}
    picked = []
    for name, kind in types.items():
        col = df[have[name]] if name in have else F.lit(None)
        picked.append(col.cast(kind).alias(name))
    return df.select(*picked)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; whole texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, salts: int = 64) -> DataFrame:
    """Inner join on ``keys`` in which hot keys are dealt over ``salts`` tasks.

    ``hot`` holds keys, no more than its caller has proved, and is broadcast: left rows of
    those are salted by a hash of all their columns, right rows are repeated for each salt.
    """
    mark = F.broadcast(hot.select(*keys).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0)
    salted = left.join(mark, keys, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(mark, keys, "left").withColumn("__salt", F.explode(each)).drop("__hot")
    return salted.join(copied, [*keys, "__salt"]).drop("__salt")
