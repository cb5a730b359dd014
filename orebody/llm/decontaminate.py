"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the power of two above their number of shingles.  For a
partition of up to U shingles, a document's shingles are cut into blocks of U; two
neighbouring blocks hold any run of U, so an item that lies in a document makes up at
least about a fifth of one such window, however long the document is.  An item and a
window are candidates when any of ``HASHES`` MinHash values agree.  An item that repeats
itself so much that its distinct shingles belong to a lower partition is a candidate
wherever a document has one of so many of its shingles that no more may be missing; none
escapes.  Each candidate is verified by the exact share of the item's distinct shingles
that the document has.

Items are a stated query set.  Up to ``BLOCK_BYTES`` of them are broadcast, and nothing of
the documents is shuffled.  More of them stay a table: their MinHash values go into one
Bloom filter of a fixed size, a single pass over the documents keeps the values that the
filter lets through, and candidates come from an equi-join on those values.  The filter
only spares rows, it decides nothing; both ways give the same pairs.

Defined results: a null or blank document or item is contained in nothing and contains
nothing; an item of one to four words is one shingle, which only a document of the same
words has; rows that repeat a doc_id, or an item_id, are judged row by row and the
pair's largest share is reported; a null item_id or doc_id is reported as null; an empty
table on either side gives no pair.  Columns other than doc_id, item_id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_join import coefficients, sets_of
from .shared import columns, settle, spread_join
from .textnp import SHINGLE, as_bytes, mix, shingle_hashes, slices, word_hashes

THRESHOLD = 0.8
#: An item that is a fifth of a window escapes with probability (1 - 0.2)**48 = 2e-5.
HASHES = 48
#: Bytes of items in one broadcast, where each item counts ``ITEM_BYTES`` more than its text.
BLOCK_BYTES, ITEM_BYTES = 16_000_000, 1_000
#: Beyond that: 32 MB of filter, and the bits that a key sets in it.
FILTER_BITS, FILTER_PROBES = 1 << 28, 4
#: In place of a size class: shingles of which a document must have one.
SOUGHT = -1
FOUND = "doc_id long, item_id long, containment double"


def levels_of(items: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of items and their bounds, each item's size class, and of how many sought shingles a document must have one (0: not repetitive)."""
    shingles, bounds = sets_of(items)
    sizes = np.diff(bounds)
    # by running shingles, repeats included: that is what an occurrence spans in a document
    words = np.diff(word_hashes(*as_bytes(items.column("text")))[2])
    level = np.ceil(np.log2(np.maximum(words - SHINGLE + 1, 1))).astype(int)
    repetitive = (np.ceil(np.log2(np.maximum(sizes, 1))).astype(int) < level) & (sizes > 0)
    # a document without any of these lacks more of the item than the threshold allows
    least = sizes - np.ceil(THRESHOLD * sizes - 1e-9).astype(np.int64) + 1
    return shingles, bounds, level, np.where(repetitive, least, 0)


def item_tables(items: pa.RecordBatch) -> dict:
    """Per size class, for each hash function, the items' minima in order and their rows; and the repetitive items' shingles to look for."""
    shingles, bounds, level, least = levels_of(items)
    plain = (np.diff(bounds) > 0) & (least == 0)
    a, b = coefficients(HASHES, seed=3)
    classes = {}
    for c in np.unique(level[plain]):
        rows = np.flatnonzero((level == c) & plain)
        own = [shingles[bounds[r] : bounds[r + 1]] for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]]).astype(np.int64)
        flat = np.concatenate(own)
        tables = []
        for k in range(HASHES):
            minima = np.minimum.reduceat(flat * a[k] + b[k], starts)
            order = np.argsort(minima, kind="stable")
            values, first = np.unique(minima[order], return_index=True)
            tables.append((values, np.append(first, len(order)), rows[order]))
        classes[int(c)] = tables
    rows = np.flatnonzero(least)
    flat = np.concatenate([shingles[bounds[r] : bounds[r] + least[r]] for r in rows]) if len(rows) else shingles[:0]
    order = np.argsort(flat, kind="stable")
    values, first = np.unique(flat[order], return_index=True)
    sought = (values, np.append(first, len(order)), np.repeat(rows, least[rows])[order])
    return {"shingles": shingles, "bounds": bounds, "ids": items.column("item_id").to_pylist(), "classes": classes, "sought": sought}


def windows(shingles: np.ndarray, bounds: np.ndarray, levels: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(level, hash function, rows, minima) of the windows of each of ``levels``, two neighbouring blocks each."""
    n = np.diff(bounds)
    if not len(shingles) or not levels:
        return
    # blocks of each level: rows' counts, and for each block the first block of the level below
    size = 1 << levels[0]
    counts = -(-n // size)
    starts = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]) * size, counts) + np.arange(counts.sum()) * size
    plans = [(levels[0], starts, np.repeat(np.arange(len(n)), counts))]
    below = counts
    for level in range(levels[0] + 1, levels[-1] + 1):
        above = -(-below // 2)
        first = np.repeat(np.concatenate([[0], np.cumsum(below)[:-1]]) - 2 * np.concatenate([[0], np.cumsum(above)[:-1]]), above) + 2 * np.arange(above.sum())
        plans.append((level, first, np.repeat(np.arange(len(n)), above)))
        below = above
    a, b = coefficients(HASHES, seed=3)
    for k in range(HASHES):
        least = shingles * a[k] + b[k]
        for level, first, owner in plans:
            least = np.minimum.reduceat(least, first)
            if level not in levels:
                continue
            window = least.copy()
            pair = owner[:-1] == owner[1:]
            window[:-1][pair] = np.minimum(least[:-1][pair], least[1:][pair])
            yield level, k, owner, window


def candidates(shingles: np.ndarray, bounds: np.ndarray, classes: dict) -> np.ndarray:
    """Distinct (row, item) pairs whose window and item share a MinHash value."""
    found: list[np.ndarray] = []
    for level, k, owner, window in windows(shingles, bounds, sorted(classes)):
        values, cuts, rows = classes[level][k]
        at = np.searchsorted(values, window)
        at[at == len(values)] = 0
        for w in np.flatnonzero(values[at] == window):
            items = rows[cuts[at[w]] : cuts[at[w] + 1]]
            found.append(np.stack([np.full(len(items), owner[w]), items], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def holders(shingles: np.ndarray, bounds: np.ndarray, sought: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct (row, item) pairs whose row has a shingle that is sought for the item."""
    values, cuts, rows = sought
    if not len(values) or not len(shingles):
        return np.zeros((0, 2), np.int64)
    at = np.searchsorted(values, shingles)
    at[at == len(values)] = 0
    on = np.flatnonzero(values[at] == shingles)
    hits = np.unique(np.stack([np.searchsorted(bounds, on, "right") - 1, at[on]], axis=1), axis=0)
    found = [np.stack([np.full(cuts[v + 1] - cuts[v], row), rows[cuts[v] : cuts[v + 1]]], axis=1) for row, v in hits]
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def by_broadcast(docs: DataFrame, items: pa.RecordBatch) -> DataFrame:
    """(doc_id, item_id, containment) of each row and each item that it holds, of items that one broadcast takes."""
    tables = docs.sparkSession.sparkContext.broadcast(item_tables(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        own = [np.sort(held["shingles"][a:b]) for a, b in zip(held["bounds"][:-1], held["bounds"][1:])]
        for batch in batches:
            for piece in slices(batch):
                data, offsets = as_bytes(piece.column("text"))
                hashes, _, words = word_hashes(data, offsets)
                shingles, bounds = shingle_hashes(hashes, words)
                names, ids, shares = [], [], []
                for row, item in np.concatenate([candidates(shingles, bounds, held["classes"]), holders(shingles, bounds, held["sought"])]):
                    have = shingles[bounds[row] : bounds[row + 1]]
                    share = np.isin(own[item], have).mean()
                    if share >= THRESHOLD:
                        names.append(piece.column("doc_id")[int(row)].as_py())
                        ids.append(held["ids"][item])
                        shares.append(float(share))
                yield pa.record_batch({"doc_id": pa.array(names, pa.int64()), "item_id": pa.array(ids, pa.int64()), "containment": pa.array(shares, pa.float64())})

    return docs.mapInArrow(run, FOUND)


def keyed(values: np.ndarray, level: int, k: int) -> np.ndarray:
    """One 64-bit key of a value, its size class and its hash function; class ``SOUGHT`` is a shingle itself."""
    return mix(values ^ mix(np.array([(level + 1) * HASHES + k + 1], np.uint64)))


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list of longs for each of ``sizes``, from end to end in ``flat``."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat.view(np.int64)))


def item_keys(items: DataFrame) -> DataFrame:
    """(item, item_id, own, keys, level): an item's shingles, the keys that make a document its candidate, and its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(HASHES, seed=3)
        for batch in batches:
            for piece in slices(batch):
                shingles, bounds, level, least = levels_of(piece)
                full = np.flatnonzero(np.diff(bounds))
                own = [shingles[bounds[r] : bounds[r + 1]] for r in full]
                keys = []
                for r, x in zip(full, own):
                    if least[r]:
                        keys.append(keyed(x[: least[r]], SOUGHT, 0))
                    else:
                        keys.append(np.concatenate([keyed((x * a[k] + b[k]).min(keepdims=True), level[r], k) for k in range(HASHES)]))
                rows = piece.select(["item", "item_id"]).take(pa.array(full))
                none = np.zeros(0, np.uint64)
                yield pa.record_batch(
                    {
                        "item": rows.column(0),
                        "item_id": rows.column(1),
                        "own": lists(np.concatenate([none, *own]), np.array([len(x) for x in own], np.int64)),
                        "keys": lists(np.concatenate([none, *keys]), np.array([len(x) for x in keys], np.int64)),
                        "level": pa.array(np.where(least[full] > 0, SOUGHT, level[full]).astype(np.int32)),
                    }
                )

    return items.mapInArrow(run, "item string, item_id long, own array<long>, keys array<long>, level int")


def passing(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in the filter; :func:`key_filter` sets them by the same rule."""
    last, low = np.uint64(len(words) * 64 - 1), np.uint64(63)
    on = np.arange(len(keys))
    for k in range(FILTER_PROBES):
        left = keys[on]
        place = ((left & last) + np.uint64(k) * (left >> np.uint64(32))) & last
        on = on[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & low)) & np.uint64(1) == 1]
    return on


def key_filter(keys: DataFrame) -> np.ndarray:
    """The Bloom filter of a column ``key`` as 64-bit words: ``FILTER_BITS`` of them at any number of keys."""
    low, step = F.col("key").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("key", 32)
    places = F.array(*[(low + k * step).bitwiseAND(FILTER_BITS - 1) for k in range(FILTER_PROBES)])
    bits = keys.select(F.explode(places).alias("place"))
    words = bits.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def doc_keys(docs: DataFrame, words: np.ndarray, levels: list[int]) -> DataFrame:
    """(row, doc_id, have, keys): the shingles and the keys that the filter lets through, of documents that have any."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                hashes, _, bounds = word_hashes(*as_bytes(piece.column("text")))
                shingles, bounds = shingle_hashes(hashes, bounds)
                rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for level, k, owner, window in windows(shingles, bounds, [c for c in levels if c != SOUGHT]):
                    key = keyed(window, level, k)
                    on = passing(key, held.value)
                    rows.append(owner[on])
                    keys.append(key[on])
                if SOUGHT in levels and len(shingles):
                    key = keyed(shingles, SOUGHT, 0)
                    on = passing(key, held.value)
                    rows.append(np.searchsorted(bounds, on, "right") - 1)
                    keys.append(key[on])
                row, key = np.concatenate(rows), np.concatenate(keys)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                row, key = row[once], key[once]
                full, counts = np.unique(row, return_counts=True)
                have = [np.unique(shingles[bounds[r] : bounds[r + 1]]) for r in full]
                names = piece.select(["row", "doc_id"]).take(pa.array(full))
                yield pa.record_batch(
                    {
                        "row": names.column(0),
                        "doc_id": names.column(1),
                        "have": lists(np.concatenate([np.zeros(0, np.uint64), *have]), np.array([len(x) for x in have], np.int64)),
                        "keys": lists(key, counts),
                    }
                )

    return docs.mapInArrow(run, "row string, doc_id long, have array<long>, keys array<long>")


def crowded(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than a 1,024th of all rows, so no more than 1,024 of them."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows.count() / 1024).select(key)


def by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of :func:`by_broadcast` for any number of items: one pass over the documents, then joins of what passes the filter.

    Rows that repeat both id and text are one.  A key, an item or a document with many
    partners is dealt over several tasks.
    """

    def named(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.withColumn(name, F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.col("text"))))

    items = settle(item_keys(named(items.where("text IS NOT NULL").dropDuplicates(["item_id", "text"]), "item", "item_id")), "item-keys")
    asked = items.select("item", F.explode("keys").alias("key"))
    levels = sorted(r["level"] for r in items.select("level").distinct().collect())  # no more than 64
    hits = doc_keys(named(docs.where("text IS NOT NULL"), "row", "doc_id"), key_filter(asked), levels)
    hits = settle(hits.dropDuplicates(["row"]), "doc-keys")
    offered = hits.select("row", F.explode("keys").alias("key"))
    pairs = settle(spread_join(offered, asked, ["key"], crowded(offered, "key")).select("row", "item").distinct(), "candidates")
    full = spread_join(pairs, items.select("item", "item_id", "own"), ["item"], crowded(pairs, "item"))
    full = spread_join(full, hits.select("row", "doc_id", "have"), ["row"], crowded(pairs, "row"))
    share = F.size(F.array_intersect("own", "have")) / F.size("own")
    return full.select("doc_id", "item_id", share.alias("containment")).where(F.col("containment") >= THRESHOLD)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment) of every document that holds an item to the threshold."""
    docs = columns(docs, doc_id="long", text="string")
    items = columns(items, item_id="long", text="string")
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ITEM_BYTES).alias("bytes")).first()["bytes"]
    if size is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = by_broadcast(docs, items.toArrow().combine_chunks().to_batches()[0]) if size <= BLOCK_BYTES else by_join(docs, items)
    return out.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item; a document without an id is kept."""
    hit = search(docs, items).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__hit")).distinct()
    hit = settle(hit, "contaminated")
    return docs.join(hit, docs["doc_id"] == hit["__hit"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
_RUNS = "unnest(list_transform(range(1, CASE WHEN len(w) >= 5 THEN len(w) - 3 WHEN len(w) > 0 THEN 2 ELSE 1 END), lambda i: array_to_string(w[i:i + 4], ' ')))"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ri AS (SELECT DISTINCT item_id, {_RUNS} AS run FROM i),
rd AS (SELECT DISTINCT doc_id, {_RUNS} AS run FROM d),
n AS (SELECT item_id, COUNT(*) AS size FROM ri GROUP BY item_id),
shared AS (SELECT doc_id, item_id, COUNT(*) AS common FROM rd JOIN ri USING (run) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, common / size::DOUBLE AS containment FROM shared JOIN n USING (item_id) WHERE common >= {THRESHOLD} * size
"""
