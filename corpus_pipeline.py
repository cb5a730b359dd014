"""The corpus pipeline: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read
again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.
Models and counts of a stage come from that stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orebody.llm import decontaminate, mixing, near_join, quality, tokens
from orebody.llm.shared import settle, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go.

    Null and empty texts are scored by the rate of the labels; rows that repeat an id are
    judged one by one; without labels every document stays as the operator's prior says.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays.

    Null and blank texts are near nothing and stay; of rows alike in id and text one stays;
    rows without an id take no part and stay.
    """
    return near_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and blank texts hold nothing and stay; all rows of an id go with the one that holds
    an item; rows without an id stay; blank items are held by nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks.

    Null and empty texts have no words and are drawn at their source's rate like all; a null
    source is a source of its own; rows that repeat an id share a draw.
    """
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, and what they hold of each document.

    A null or empty text is the end id alone; copies of a document are documents, in the order
    of ids, null ids first.
    """
    return tokens.tokenize(spark, docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", pack_tokens),
]

#: The classifier, the MinHash join and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
