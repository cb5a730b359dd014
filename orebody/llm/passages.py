"""Documents that share a passage of words with another document.

A passage is a run of ``LENGTH`` words; words are runs of letters, digits and bytes beyond
ASCII, of which only A-Z are lower-cased, so that passages meet whatever stands between
their words.  A run that repeats inside one document only is not shared.

Any passage holds ``LENGTH - GRAM + 1`` grams of ``GRAM`` words; the leftmost of their least
hash is its anchor, at the same place in all copies.  Anchors whose gram is unique are
dropped.  An anchor's context is the words of all passages that can be anchored there: a
context of two rows shares its passages as a whole, and only where a gram has several
contexts are the passages of one row for each context compared.

Words, grams, passages and contexts are compared by 64-bit hashes (gram and context
together are a key of 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_KEYS, ROW, settle, spread_join
from .textnp import as_bytes, least_of_runs, mix, powers, prefix_hash, rows_of, slices, span_hash, spans

LENGTH = 50
GRAM = 10
REACH = LENGTH - GRAM
#: Words beyond this are scanned in overlapping parts.
PART = 1 << 22
#: Bytes between words.
GAP = np.ones(256, bool)
GAP[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def anchored(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, context) of every anchor, and (passage, its anchor's number) of every passage."""
    data, offsets = as_bytes(texts)
    data = LOWER[data]
    starts, ends = spans(data, offsets, GAP)
    n = len(starts)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.uint64, np.int64))
    words = span_hash(prefix_hash(data), starts, ends)
    row = rows_of(starts, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(n)[0], out=prefix[1:])
    at = np.arange(n - GRAM + 1)
    grams = span_hash(prefix, at, at + GRAM)
    parts = [least_of_runs(grams[s : s + PART + REACH], REACH) + s for s in range(0, n - LENGTH + 1, PART)]
    least = np.concatenate(parts)
    whole = np.flatnonzero(row[: n - LENGTH + 1] == row[LENGTH - 1 :])  # passages do not cross rows
    places, number = np.unique(least[whole], return_inverse=True)
    left = np.minimum(places - bounds[row[places]], REACH)
    right = np.minimum(bounds[row[places] + 1] - places, LENGTH)
    context = mix(span_hash(prefix, places - left, places + right) ^ (left * 1024 + right).astype(np.uint64))
    return row[places], grams[places], context, span_hash(prefix, whole, whole + LENGTH), number


def anchors_of(docs: DataFrame) -> DataFrame:
    """(gram, context, *ROW) of every anchor of rows (*ROW, text), those of equal contexts in a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            row, gram, context, *_ = anchored(part.column("text"))
            order = np.lexsort((gram, context, row))
            row, gram, context = row[order], gram[order], context[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (context[1:] != context[:-1]) | (gram[1:] != gram[:-1])
            row = row[fresh]
            out = {"gram": pa.array(gram[fresh].view(np.int64)), "context": pa.array(context[fresh].view(np.int64))}
            yield pa.record_batch(out | {c: pa.array(part.column(c).to_numpy()[row], pa.int64()) for c in ROW})

    return docs.mapInArrow(run, "gram long, context long, doc long, row long")


def passages_of(texts: DataFrame) -> DataFrame:
    """(passage, gram, context, n, *ROW) of the passages of the wanted contexts of ``texts`` (*ROW, text, wants)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            row, gram, context, passage, number = anchored(part.column("text"))
            wants = part.column("wants")
            owner = np.repeat(np.arange(part.num_rows), wants.value_lengths().to_numpy())
            want = wants.flatten()
            key = mix(want.field("gram").to_numpy().view(np.uint64) ^ mix(want.field("context").to_numpy().view(np.uint64) + owner.astype(np.uint64)))
            order = np.argsort(key)
            own = mix(gram ^ mix(context + row.astype(np.uint64)))
            found = np.minimum(np.searchsorted(key[order], own), len(key) - 1)
            wanted = key[order][found] == own
            on = np.flatnonzero(wanted[number])
            anchor = number[on]
            out = {"passage": passage[on].view(np.int64), "gram": gram[anchor].view(np.int64), "context": context[anchor].view(np.int64)}
            out |= {"n": want.field("n").to_numpy()[order][found[anchor]]} | {c: part.column(c).to_numpy()[row[anchor]] for c in ROW}
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return texts.mapInArrow(run, "passage long, gram long, context long, n long, doc long, row long")


def sharing(docs: DataFrame) -> DataFrame:
    """(*ROW) of the rows (*ROW, text) that share a passage with another row, each once."""
    anchors = settle(anchors_of(docs.where(F.octet_length("text") >= 2 * LENGTH - 1)), "passage-anchors")
    floor = anchors.count() // HOT_KEYS
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    grams = settle(grams.select("gram", "n", (F.col("low") != F.col("high")).alias("mixed")), "passage-grams")
    hot = grams.where(F.col("n") > floor).select("gram")
    shared = settle(spread_join(anchors, grams.drop("n"), ["gram"], hot), "passage-shared")
    contexts = shared.where("mixed").groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct(*ROW)).alias("first"))
    contexts = settle(contexts.select("gram", "context", "n", "first.*"), "passage-contexts")

    wants = contexts.groupBy(*ROW).agg(F.collect_list(F.struct("gram", "context", "n")).alias("wants"))  # a text's own anchors
    passages = settle(passages_of(docs.select(*ROW, "text").join(wants, ROW)), "passages")
    ends = [f(F.struct(*ROW)) for f in (F.min, F.max)]
    common = passages.groupBy("passage").agg(F.count("*").alias("rows"), (ends[0] != ends[1]).alias("apart"), F.max("n").alias("most"))
    common = settle(common.where("apart OR most > 1").select("passage", "rows"), "passage-common")
    alone = passages.where("n = 1").select("passage", *ROW)
    alone = spread_join(alone, common.select("passage"), ["passage"], common.where(F.col("rows") > floor).select("passage")).select(*ROW)

    many = contexts.where("n > 1")
    equal = spread_join(shared.where("mixed").drop("mixed"), many.select("gram", "context"), ["gram", "context"], many.where(F.col("n") > floor).select("gram", "context"))
    equal = shared.where("NOT mixed").select(*ROW).unionByName(equal.select(*ROW))
    return equal.unionByName(alone).distinct()
