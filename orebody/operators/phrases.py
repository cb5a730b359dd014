"""Phrases of a dictionary in a table of texts: the longest one at each place, and scores by concept.

Texts and phrases are the same words: lower case, runs of letters and digits.  An
Aho-Corasick automaton over the dictionary reads each text once, whatever the dictionary's
size; of phrases that begin at a word the longest counts, and the next one begins behind it.
The dictionary is a table of phrases that people wrote; it is broadcast, and one beyond
``MOST_BYTES`` is an error.

Null and empty texts hold nothing; a phrase without a word is in no text; of phrases that are
the same words every concept is found; rows that repeat a key are read one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in one broadcast.
MOST_BYTES = 64_000_000
#: What separates words.
GAP = r"[^\p{L}\p{N}]+"


def spaced(text: Column) -> Column:
    """The words of a text, with two blanks between them and one around: a phrase with one blank at either end matches whole words."""
    words = F.trim(F.regexp_replace(F.lower(text), GAP, " "))
    return F.when(words != "", F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        own.add_word(phrase, (k, len(phrase)))
    own.make_automaton()
    return own


def longest(own: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, phrase) of the longest match at each place from the left, each behind the one before."""
    free = 0
    for start, less, which in sorted((end + 1 - n, -n, which) for end, (which, n) in own.iter(text)):
        if start >= free:
            free = start - less
            yield start, free, which


def find(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, place, phrase, concept, weight) of every phrase found; ``place`` is its first word's number from 1.

    dictionary: phrase, concept, weight.
    """
    spark = texts.sparkSession
    known = dictionary.select(spaced(F.col("phrase")).alias("__spaced"), "phrase", "concept", F.col("weight").cast("double").alias("weight")).where("__spaced IS NOT NULL")
    distinct = known.select("__spaced").distinct()
    size = distinct.agg(F.sum(F.octet_length("__spaced")).alias("n")).first()["n"] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a dictionary of {size} bytes: at most {MOST_BYTES}")
    held = spark.sparkContext.broadcast(sorted(r["__spaced"] for r in distinct.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        own = automaton(phrases) if phrases else None
        for batch in batches:
            rows: list[int] = []
            places: list[int] = []
            found: list[str] = []
            for k, t in enumerate(batch.column("__text").to_pylist() if own else []):
                if not t:
                    continue
                starts = None
                for start, _, which in longest(own, t):
                    if starts is None:
                        # a word begins behind a blank
                        letters = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                        starts = np.flatnonzero((letters[1:] != 32) & (letters[:-1] == 32)) + 1
                    rows.append(k)
                    places.append(int(np.searchsorted(starts, start + 1)) + 1)
                    found.append(phrases[which])
            yield pa.record_batch({"__key": batch.column("__key").take(pa.array(rows, pa.int64())), "place": pa.array(places, pa.int32()), "__spaced": pa.array(found, pa.string())})

    kind = texts.schema[key].dataType.simpleString()
    hits = texts.select(F.col(key).alias("__key"), spaced(F.col(text)).alias("__text")).mapInArrow(run, f"__key {kind}, place int, __spaced string")
    return hits.join(F.broadcast(known), "__spaced").select(F.col("__key").alias(key), "place", "phrase", "concept", "weight")


def scores(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, concept, n, score): how often the phrases of a concept stand in a text, and the sum of their weights."""
    return find(texts, key, text, dictionary).groupBy(key, "concept").agg(F.count("*").alias("n"), F.sum("weight").alias("score"))


def best(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, concept, score): the concept of the highest score of each text that has any; equal ones by name."""
    order = F.struct((-F.col("score")).alias("less"), "concept")
    return scores(texts, key, text, dictionary).groupBy(key).agg(F.min(order).alias("first")).select(key, "first.concept", (-F.col("first.less")).alias("score"))
