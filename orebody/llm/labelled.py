"""Bounded samples of labelled documents, and folds that labels are not learned from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns, settle
from .textnp import slices

#: Documented bounds of what a classifier is fitted on: rows of each class, and code points of a text.
ROWS_PER_CLASS = 1200
SAMPLE_CHARS = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column) -> pa.Table:
    """(text, label) of at most ``ROWS_PER_CLASS`` documents of each class, picked by a hash of the id.

    ``learn`` says which rows of labels may be learned from.  An id with several labels
    counts as its largest.
    """
    labels = columns(labels, doc_id="long", **{column: "int"}).where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    once = labels.where(learn).groupBy("doc_id").agg(F.max(column).alias("label"))
    docs = columns(docs, doc_id="long", text="string")
    texts = docs.where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    # ids alone are joined; an id that many rows repeat counts once
    known = settle(texts.select("doc_id").join(once, "doc_id").groupBy("doc_id", "label").count().drop("count"), "labelled")
    order = [F.xxhash64("doc_id", F.lit(column)), F.col("doc_id")]
    picked = None
    for value in (0, 1):
        own = known.where(F.col("label") == value).orderBy(*order).limit(ROWS_PER_CLASS)
        picked = own if picked is None else picked.unionByName(own)
    rows = picked.collect()  # at most two classes' worth of ids
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, label int")
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    # an id that many rows repeat is one example
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "label").toArrow()


def pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sample in runs of rows of a few megabytes, which bounds what a fit holds at a time."""
    for batch in table.combine_chunks().to_batches():
        yield from slices(batch)
