"""Upserts of a stream into a table by partitions.

Within a watermark a repeated row is dropped before anything is written.  Each batch then
reads the partitions that it touches, keeps of each key the row of the latest time (of equal
times the one that a hash of the row puts first), and replaces these partitions and no
others.  So a late row never takes the place of a later one, a batch that is played again
leaves the table as it is, and the order of batches does not matter.  A row that comes later
than the watermark allows is not applied: Spark drops it and counts it in the query's progress
(``numRowsDroppedByWatermark``).  Rows with a null time are dropped with them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orebody.sources.scratch import settle


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # nothing has been written there yet
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Of each key the row of the latest time; of equal times the first by a hash of the row."""
    names = rows.columns
    order = F.struct(F.col(time), F.xxhash64(*names), F.struct(*names).alias("row"))
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(order).alias("top")).select("top.row.*")


def merge_batch(batch: DataFrame, path: str, keys: list[str], time: str, partition: str) -> None:
    """Merge rows into the table at ``path``, whose partitions are by a column that is one of the keys."""
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys")
    spark = batch.sparkSession
    batch = settle(batch, "batch")
    touched = [r[partition] for r in batch.select(partition).distinct().collect()]  # a row for each partition
    if not touched:
        return
    old = _table(spark, path)
    rows = batch
    if old is not None:
        known = [t for t in touched if t is not None]
        own = F.col(partition).isin(*known)
        own = own | F.col(partition).isNull() if None in touched else own
        old = old.where(own)
        rows = old.select(*[F.col(c).cast(batch.schema[c].dataType).alias(c) for c in batch.columns]).unionByName(batch)
    merged = settle(latest(rows, keys, time), "merged")
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], time: str, delay: str, partition: str, checkpoint: str) -> StreamingQuery:
    """Start to merge a stream into the table at ``path``; ``checkpoint`` keeps where it was, so it goes on after a stop."""
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])
    return once.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path, keys, time, partition)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
