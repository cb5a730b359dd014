"""Ranked lexical search over bit-sliced Bloom signatures.

An index holds blocks of documents of like size.  Each document's distinct terms set bits of
a Bloom signature; a block stores one bitmap of documents for each bit.  A term enters once
for each level of its frequency that it reaches (1, 2, 3, 5, 9, ...), so the bitmaps that a
term's bits select, and-ed, mark every document that holds the term so often, and perhaps a
few more.  Sums of the marked documents' weights, times what a level adds to a term's share
at the document's length, bound each score from above.

A search makes two passes over the blocks and none over the texts.  The first finds each
item's documents of the highest bounds; their exact scores give a score that the k-th best
reaches.  The second emits every document whose bound does not exclude it.  Those, and no
others, are joined to their texts and scored exactly.

Signatures are built where the documents stand, without a shuffle; block bytes, terms at
hand and best documents of a task are bounded.  Items are a stated query set, broadcast in
blocks of at most ``ITEM_BYTES`` of text (an item beyond that is a block of its own).

Defined results: a null text, or one without terms, is no document and is never found; an
item without terms, or whose terms are in no document, has no row; rows that repeat a doc_id
are documents of their own and are found one by one, equal ones included; rows that repeat
an item_id are asked one by one, and each has ranks of its own; a null doc_id is ordered last among equal scores;
an empty table on either side gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.operators.running import running

from .shared import batch_rows, columns, settle, table
from .textnp import as_bytes, mix, prefix_hash, rows_of, slices, span_hash, spans

#: Fixed values of the contract: bytes between terms, best documents an item.
GAP = np.zeros(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    GAP[_first : _last + 1] = True
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BEST = 20
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
#: Least frequencies of the levels; the last has no upper end.
LEVELS = (1, 2, 3, 5, 9, 17, 33, 65, 129, 257, 513, 1025)
#: Bits of a signature for each key at least, and bits that a key sets.
BITS_A_KEY, HASHES = 16, 4
#: Documents in a block, and bits of a block, at most (eight documents at least).
BLOCK_DOCS, BLOCK_BITS = 2048, 1 << 23
#: Blocks, of up to a MB each, and texts in an Arrow batch.
BATCH_BLOCKS, BATCH_TEXTS = 8, 1000
#: Distinct terms whose document counts a task holds before it writes them.
TERMS_HELD = 1_000_000
ITEM_BYTES, ITEM_OWN_BYTES = 1_000_000, 100
#: Candidate documents up to this many are broadcast as ids; beyond, they are joined by a shuffle.
BROADCAST_IDS = 200_000


class Index(NamedTuple):
    blocks: DataFrame
    frequencies: DataFrame


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term of lower-cased bytes."""
    starts, ends = spans(data, offsets, GAP)
    return span_hash(prefix_hash(data), starts, ends), rows_of(starts, offsets)


def positions(hashes: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """The bits that a term at a level sets in signatures of 2**bits, one column for each of HASHES."""
    one = mix(hashes + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64)))
    two = mix(one) | np.uint64(1)
    mask = (np.uint64(1) << np.asarray(bits, np.uint64)) - np.uint64(1)
    return np.stack([(one + np.uint64(k) * two) & mask for k in range(HASHES)], axis=-1).astype(np.int64)


class _Block:
    """Documents of one signature size, until there are enough of them."""

    def __init__(self, bits: int):
        self.bits = bits
        self.most = min(BLOCK_DOCS, max(8, BLOCK_BITS >> bits))
        self.clear()

    def clear(self) -> None:
        self.marks = np.zeros((1 << self.bits, self.most), bool)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def rows(self) -> dict:
        width = -(-len(self.ids) // 8) * 8
        packed = np.packbits(self.marks[:, :width], axis=1)
        out = {"bits": self.bits, "ids": self.ids, "sizes": self.sizes, "slices": packed.tobytes()}
        self.clear()
        return out


_INDEX = pa.schema(
    [("bits", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _row(**values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([values.get(f.name)], f.type) for f in _INDEX], schema=_INDEX)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, _Block] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms, place = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return terms, np.bincount(place, np.concatenate([c for _, c in held]), len(terms)).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            data, offsets = as_bytes(part.column("text"))
            hashes, row = term_hashes(LOWER[data], offsets)
            if not len(hashes):
                continue
            sizes = np.bincount(row, minlength=part.num_rows)
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]))
            often = np.diff(np.append(first, len(hashes)))
            hashes, row = hashes[first], row[first]
            own, counts = np.unique(hashes, return_counts=True)
            held.append((own, counts))
            n_held += len(own)
            keys = sum(np.bincount(row[often >= least], minlength=part.num_rows) for least in LEVELS)
            bits = np.ceil(np.log2(np.maximum(keys * BITS_A_KEY, 64))).astype(np.int64)
            ids = part.column("doc_id").to_pylist()
            placed = np.zeros(part.num_rows, np.int64)
            full = np.flatnonzero(sizes)
            for b in np.unique(bits[full]):
                block = open_blocks.setdefault(int(b), _Block(int(b)))
                rows = full[bits[full] == b]
                while len(rows):
                    now, rows = rows[: block.most - len(block.ids)], rows[block.most - len(block.ids) :]
                    placed[now] = np.arange(len(block.ids), len(block.ids) + len(now))
                    block.ids += [ids[r] for r in now]
                    block.sizes += sizes[now].tolist()
                    inside = np.zeros(part.num_rows, bool)
                    inside[now] = True
                    for level, least in enumerate(LEVELS):
                        on = np.flatnonzero(inside[row] & (often >= least))
                        if not len(on):
                            break
                        where = positions(hashes[on], level, int(b))
                        block.marks[where, placed[row[on]][:, None]] = True
                    if len(block.ids) == block.most:
                        yield _row(**block.rows())
            if n_held > 4 * TERMS_HELD:
                held = [merged()]
                n_held = len(held[0][0])
                if n_held > TERMS_HELD:
                    yield _row(terms=held[0][0].view(np.int64), counts=held[0][1])
                    held, n_held = [], 0
    for block in open_blocks.values():
        if block.ids:
            yield _row(**block.rows())
    if held:
        terms, counts = merged()
        yield _row(terms=terms.view(np.int64), counts=counts)


def build(docs: DataFrame) -> Index:
    """The index of a frame with doc_id and text: written once, searched often.

    blocks: bits, ids, sizes (terms of each document) and slices (2**bits bitmaps of documents);
    frequencies: term (its hash) and df.
    """
    docs = columns(docs, doc_id="long", text="string")
    with batch_rows(docs.sparkSession, BATCH_TEXTS):
        written = settle(docs.mapInArrow(_signed, "bits int, ids array<long>, sizes array<long>, slices binary, terms array<long>, counts array<long>"), "signatures")
    pairs = written.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("r"))
    frequencies = pairs.groupBy(F.col("r.terms").alias("term")).agg(F.sum("r.counts").alias("df"))
    return Index(written.where("bits IS NOT NULL").select("bits", "ids", "sizes", "slices"), settle(frequencies, "frequencies"))


class Items:
    """A block of items: their terms' weights, and what must be reached."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        counts = [Counter(TERM.findall((t or "").encode().translate(LOWER_BYTES))) for t in texts]
        self.terms = sorted(set().union(*counts))
        data, offsets = as_bytes(pa.array(self.terms, pa.binary()))
        self.hashes = term_hashes(data, offsets)[0] if self.terms else np.zeros(0, np.uint64)
        self.counts = counts
        self.weights: dict[bytes, int] = {}

    def weigh(self, n: int, total: int, frequency: dict[int, int]) -> None:
        """Weights of the terms that are in a document, and each item's terms by place."""
        df = {t: frequency.get(h, 0) for t, h in zip(self.terms, self.hashes.view(np.int64).tolist())}
        self.weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items() if d}
        self.n, self.total = n, total
        known = np.array([t in self.weights for t in self.terms], bool)
        self.hashes = self.hashes[known]
        self.terms = [t for t, on in zip(self.terms, known) if on]
        place = {t: i for i, t in enumerate(self.terms)}
        self.rows = [np.array([place[t] for t in c if t in place], np.int64) for c in self.counts]
        self.shares = [np.array([self.weights[t] * m for t, m in c.items() if t in place], np.float64) for c in self.counts]
        self.least: list[tuple[int, int | None]] = [(1, None)] * len(self.ids)

    def length_part(self, sizes: np.ndarray) -> np.ndarray:
        return 75 + (25 * sizes * self.n) // self.total

    def bounds(self, bits: int, sizes: np.ndarray, packed: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, upper bound of each document's score) for the items that may have a document in the block."""
        m = self.length_part(sizes)
        below = np.zeros(len(sizes), np.int64)
        levels = []
        marked = None
        on = np.arange(len(self.terms))
        for level in range(len(LEVELS)):
            if not len(on):
                break
            where = positions(self.hashes[on], level, bits)
            here = packed[where[:, 0]].copy()
            for k in range(1, HASHES):
                here &= packed[where[:, k]]
            if marked is not None:
                here &= marked
            some = here.any(axis=1)
            on, marked = on[some], here[some]
            # the share of the level's highest frequency, rounded down like the score's; without an end it stays below 1,000,000
            top = (1_000_000_000 * (LEVELS[level + 1] - 1)) // (1000 * (LEVELS[level + 1] - 1) + 12 * m) if level + 1 < len(LEVELS) else np.full(len(sizes), 1_000_000)
            place = np.full(len(self.terms), -1)
            place[on] = np.arange(len(on))
            levels.append((place, marked, (top - below).astype(np.float64)))
            below = top
        for item, (rows, shares) in enumerate(zip(self.rows, self.shares)):
            out = None
            for place, marks, step in levels:
                at = place[rows]
                there = at >= 0
                if not there.any():
                    break
                docs = np.unpackbits(marks[at[there]], axis=1, count=len(sizes))
                added = (shares[there] @ docs) * step
                out = added if out is None else out + added
            if out is not None:
                yield item, out.astype(np.int64)

    def score(self, item: int, size: int, found: Counter) -> int:
        m = 75 + (25 * size * self.n) // self.total
        return sum(self.weights[t] * c * ((1_000_000_000 * found[t]) // (1000 * found[t] + 12 * m)) for t, c in self.counts[item].items() if t in self.weights and found[t])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, ids, whether an id is null, sizes, bitmaps) of each block."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column("ids")[r].values
            sizes = batch.column("sizes")[r].values.to_numpy()
            bits = batch.column("bits")[r].as_py()
            packed = np.frombuffer(batch.column("slices")[r].as_buffer(), np.uint8).reshape(1 << bits, -1)
            yield bits, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, packed


def _pairs(items: list[int], ids: list[np.ndarray], nulls: list[np.ndarray], bounds: list[np.ndarray]) -> pa.RecordBatch:
    own = np.repeat(np.array(items, np.int32), [len(x) for x in ids])
    flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((ids, np.int64), (nulls, bool), (bounds, np.int64))]
    return pa.record_batch({"item": pa.array(own, pa.int32()), "doc_id": pa.array(flat[0], pa.int64(), mask=flat[1]), "bound": pa.array(flat[2], pa.int64())})


PAIRS = "item int, doc_id long, bound long"


def highest(blocks: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, bound): in each task, each item's k documents of the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Items = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for bits, ids, nulls, sizes, packed in _blocks(batches):
            for item, bound in asked.bounds(bits, sizes, packed):
                have = best.get(item)
                on = np.flatnonzero(bound > (have[0].min() if have is not None and len(have[0]) == k else 0))
                if not len(on):
                    continue
                rows = (bound[on], ids[on], nulls[on])
                if have is not None:
                    rows = tuple(np.concatenate(x) for x in zip(have, rows))
                if len(rows[0]) > k:
                    keep = np.lexsort((rows[1], rows[2], -rows[0]))[:k]
                    rows = tuple(x[keep] for x in rows)
                best[item] = rows
        if best:
            yield _pairs(list(best), [x[1] for x in best.values()], [x[2] for x in best.values()], [x[0] for x in best.values()])

    return blocks.mapInArrow(run, PAIRS)


def not_excluded(blocks: DataFrame, shared) -> DataFrame:
    """(item, doc_id, bound) of every document whose bound reaches what the k-th best of a few has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Items = shared.value
        for bits, ids, nulls, sizes, packed in _blocks(batches):
            found: list[tuple] = []
            for item, bound in asked.bounds(bits, sizes, packed):
                least, last = asked.least[item]
                # among equal scores the smaller id is better; null ids come last
                equal = (bound == least) & (True if last is None else ~nulls & (ids <= last))
                on = np.flatnonzero((bound > least) | equal)
                if len(on):
                    found.append((item, ids[on], nulls[on], bound[on]))
            if found:
                yield _pairs(*(list(x) for x in zip(*found)))

    return blocks.mapInArrow(run, PAIRS)


def exact(docs: DataFrame, pairs: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, score, place): exact scores of pairs, the k best of each item."""
    # no more items to a document than a block of items has
    with batch_rows(docs.sparkSession, BATCH_BLOCKS):
        asked = settle(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")).withColumnRenamed("doc_id", "own"), "candidates")
    wanted = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("own"))).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Items = shared.value
        for batch in batches:
            rows: list[tuple[int, int | None, int]] = []
            for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                terms = TERM.findall((text or "").encode().translate(LOWER_BYTES))
                found = Counter(terms)
                rows += [(i, doc_id, s) for i in items if (s := held.score(i, len(terms), found)) > 0]
            item, ids, scores = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch({"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    scored = texts.mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # a task passes on no more than its own k best of an item
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(index: Index, docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores for each item, from an index of ``docs``."""
    with batch_rows(docs.sparkSession, BATCH_TEXTS):
        return _search(index, columns(docs, doc_id="long", text="string"), items, k)


def _search(index: Index, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    items = columns(items, item_id="long", text="string").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ITEM_OWN_BYTES)
    order = [F.xxhash64("item_id", "text").asc(), F.col("item_id").asc(), F.col("text").asc()]
    items = settle(running(items, order, ("bytes",)).withColumn("block", F.floor(F.col("bytes_before") / ITEM_BYTES)), "items")
    parts = (items.agg(F.max("block").alias("n")).first()["n"] or 0) + 1
    corpus = index.blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    results: list[DataFrame] = []
    for part in range(parts):
        rows = items.where(F.col("block") == part).select("item_id", "text").collect()
        asked = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not corpus["n"] or not asked.terms:
            continue
        hashes = spark.createDataFrame([(int(h),) for h in asked.hashes.view(np.int64)], "term long")
        frequency = {r["term"]: r["df"] for r in index.frequencies.join(F.broadcast(hashes), "term").collect()}
        asked.weigh(corpus["n"], corpus["total"], frequency)
        first = spark.sparkContext.broadcast(asked)
        seeds = highest(index.blocks, first, k).withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= k)
        # one row an item
        for r in exact(docs, seeds.select("item", "doc_id"), first, k).where(F.col("place") == k).collect():
            asked.least[r["item"]] = (r["score"], r["doc_id"])
        second = spark.sparkContext.broadcast(asked)
        pairs = not_excluded(index.blocks, second).select("item", "doc_id").distinct()
        named = spark.createDataFrame(list(enumerate(asked.ids)), "item int, item_id long")
        found = exact(docs, pairs, second, k).join(F.broadcast(named), "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")
        results.append(settle(found, "found"))
        for held in (first, second):
            held.destroy()
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(build(docs), docs, table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT item_id, term, COUNT(*) AS often FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
size AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
corpus AS (SELECT COUNT(*)::BIGINT AS n_all, SUM(n)::BIGINT AS l_all FROM size),
tf AS (SELECT doc_id, term, COUNT(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
weight AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, n_all),
score AS (
  SELECT item_id, doc_id, SUM(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= {BEST}
"""
