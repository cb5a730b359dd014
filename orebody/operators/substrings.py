"""Substring search by an index of runs of three characters.

Rows are taken in blocks of some million characters.  Postings say for each block which of its
rows hold a run of three lower-case characters: a row for a run and a block, with the keys as a
list, so that their number does not grow with the occurrences.  They lie by buckets of runs and
are sorted by run, so that a search reads its own runs alone.  A pattern's rarest runs are
intersected block by block, and only the rows that have all of them are joined to their texts
and tested exactly, by the rule of ``ILIKE`` with the pattern's signs standing for themselves.
Patterns below three characters have no run; they are tested on all rows.

Null texts match nothing.  A null or empty pattern has no row in a batch, and is no filter
alone.  Rows that repeat a key stand and fall together: each is tested by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.expressions import contains_text
from orebody.sources.scratch import settle

RUN = 3
#: So many of a pattern's runs are intersected, the rarest first.
RAREST = 4
#: Runs of patterns, and keys of candidates, up to so many rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Characters of a block of rows (a longer text is a block of its own), and buckets of runs.
BLOCK_CHARS = 4_000_000
BUCKET_BITS = 6


class Index(NamedTuple):
    """postings: bucket, gram, block, n, keys; frequencies: gram, n."""

    postings: DataFrame
    frequencies: DataFrame


def runs(low: bytes | None) -> np.ndarray:
    """The distinct runs of three characters of a lower-case text, 21 bits a character, ascending."""
    chars = np.frombuffer((low or b"").decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.unique(sum(chars[k : len(chars) - RUN + 1 + k] << (21 * (RUN - 1 - k)) for k in range(RUN))) if len(chars) >= RUN else np.zeros(0, np.int64)


def bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _block(number: int, keys: list[pa.Array], found: list[np.ndarray]) -> pa.RecordBatch:
    keys = pa.concat_arrays(keys)
    grams = np.concatenate(found)
    order = np.argsort(grams, kind="stable")
    own, first = np.unique(grams[order], return_index=True)
    ends = np.append(first, len(grams)).astype(np.int32)
    held = keys.take(pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found])[order]))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket(own)), pa.array(own), pa.array(np.full(len(own), number, np.int64)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), held)],
        names=["bucket", "gram", "block", "n", "keys"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (key, lower-case text as bytes), a block at a time."""
    number = TaskContext.get().partitionId() << 32
    keys: list[pa.Array] = []
    found: list[np.ndarray] = []
    chars = 0
    for batch in batches:
        own, texts = batch.columns
        for i, text in enumerate(texts):
            keys.append(own.slice(i, 1))
            found.append(runs(text.as_py()))
            chars += len(text.as_buffer())
            if chars >= BLOCK_CHARS:
                yield _block(number, keys, found)
                number, keys, found, chars = number + 1, [], [], 0
    if found:
        yield _block(number, keys, found)


def build(rows: DataFrame, key: str, text: str) -> Index:
    """The index of a text column, to be written once and asked often."""
    low = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).cast("binary").alias("low"))
    kind = low.schema["key"].dataType.simpleString()
    blocks = low.mapInArrow(_blocks, f"bucket int, gram long, block long, n int, keys array<{kind}>")
    # by buckets, large ones cut and small ones put together as their bytes ask
    postings = settle(blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram"), "postings")
    return Index(postings, settle(postings.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def search(index: Index, rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """The rows whose text holds the pattern, case aside."""
    test = contains_text(F.col(text), pattern)
    own = runs(rows.sparkSession.range(1).select(F.lower(F.lit(pattern)).cast("binary").alias("low")).first()["low"]).tolist()
    if not own:
        return rows.where(test)
    counts = {r["gram"]: r["n"] for r in index.frequencies.where(F.col("gram").isin(*own)).collect()}
    chosen = sorted(own, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    buckets = {int(b) for b in bucket(np.array(chosen))}
    hits = index.postings.where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*chosen)).select("gram", F.explode("keys").alias("key")).groupBy("key").agg(F.countDistinct("gram").alias("n"))
    hits = settle(hits.where(F.col("n") == len(chosen)).select(F.col("key").alias("__key")), "candidates")
    return rows.join(_small(hits), rows[key] == F.col("__key"), "left_semi").where(test)


def search_batch(index: Index, rows: DataFrame, key: str, text: str, patterns: DataFrame, pattern_key: str, pattern: str) -> DataFrame:
    """(pattern_key, key) of every row whose text holds a pattern, for a table of patterns."""
    asked = patterns.where(F.length(pattern) > 0).select(F.col(pattern_key).alias("__pattern"), F.lower(pattern).alias("__low"))
    # patterns are few beside texts
    asked = settle(asked.withColumn("__grams", F.udf(lambda low: runs(low).tolist(), "array<long>")(F.col("__low").cast("binary"))), "patterns")
    long = asked.where(F.size("__grams") > 0).select("__pattern", "__low", F.size("__grams").alias("__all"), F.explode("__grams").alias("gram"))
    counted = long.join(index.frequencies, "gram")
    own = Window.partitionBy("__pattern", "__low")
    # a pattern with a run that no text has is in no text
    counted = counted.withColumn("__known", F.count("*").over(own)).where(F.col("__known") == F.col("__all"))
    place = F.row_number().over(own.orderBy("n", "gram"))
    chosen = counted.withColumn("__place", place).where(F.col("__place") <= RAREST).select("__pattern", "__low", "gram", F.least(F.col("__all"), F.lit(RAREST)).alias("__wanted"))
    chosen = settle(chosen, "chosen-grams")
    # a text that holds the pattern has all the runs in its own block; a key of several blocks is one candidate
    hits = index.postings.select("gram", "block", "keys").join(_small(chosen), "gram").groupBy("__pattern", "__low", "__wanted", "block").agg(F.collect_list("keys").alias("lists"))
    hits = hits.where(F.size("lists") == F.col("__wanted"))
    both = F.aggregate(F.slice("lists", 2, RAREST), F.element_at("lists", 1), F.array_intersect)
    hits = settle(hits.select("__pattern", "__low", F.explode(both).alias("__key")).distinct(), "candidates")
    texts = rows.select(key, F.lower(text).alias("__text"))
    found = texts.join(_small(hits), texts[key] == F.col("__key")).where(F.contains(F.col("__text"), F.col("__low"))).select("__pattern", key)
    # at most two characters each: all of them fit beside every row
    short = asked.where(F.size("__grams") == 0).agg(F.collect_set(F.struct("__pattern", "__low")).alias("__short"))
    scanned = texts.crossJoin(F.broadcast(short))
    scanned = scanned.select(key, F.explode(F.filter("__short", lambda p: F.contains(F.col("__text"), p["__low"]))).alias("p")).select("p.__pattern", key)
    return found.unionByName(scanned).withColumnRenamed("__pattern", pattern_key)
