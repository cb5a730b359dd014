"""N-gram Jaccard join: Bayesian pruning of MinHash candidates, exact verification.

Documents with equal sets of five-word shingles are one class.  Classes that share a band
of MinHash values fall into one cluster; inside a cluster every pair is compared a few
MinHash values at a time and dropped once the posterior probability that its similarity
reaches the threshold is below a tolerance; what remains is verified on the exact sets.
A cluster beyond one block is worked on in the cheaper of two ways: by its bands' buckets,
where only rows that share a band meet and a pair is compared at the first band that it
shares, or as a whole.  Either is cut into blocks by the size of the sets, so that blocks
whose sizes cannot reach the threshold never meet; each pair of blocks is a task's work,
and only counts and a spanning forest leave it, never the pairs.

Words are runs without ASCII blanks, compared as they stand.  Defined results: a null or
blank text has no shingle and no link; a text of one to four words is one shingle; rows
that repeat a doc_id are rows of their own, compared with each other like all, counted
each, and known by their id in what is returned; a row with a null doc_id is returned
without a component and takes no part; an empty table gives an empty result.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.components import components

from .shared import batch_rows, columns, settle
from .textnp import as_bytes, mix, shingle_hashes, slices, word_hashes

#: Similarity as a fraction of integers, so that the test on counts is exact.
THRESHOLD = (4, 5)
#: A pair at the threshold shares no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: MinHash values compared at a time, and in all, before the exact test.
STEP, COMPARED = 16, 64
#: A pair is dropped when its posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: A block of a cluster holds about so many classes, or bytes of shingles.
BLOCK_ROWS, BLOCK_BYTES = 1024, 12_000_000
#: Sets at the threshold differ in size by a factor of 1.25 at most, so by one level.
LEVEL_BASE = 1.26
#: Levels of clusters up to this many rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LEVELS = 100_000
TILE = 512


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n hash functions, from a rule."""
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return base[:n] | np.uint64(1), base[n:]


def min_hashes(shingles: np.ndarray, bounds: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n minima of each run of shingles, as 32-bit words; runs must not be empty."""
    a, b = coefficients(n, seed)
    out = np.empty((len(bounds) - 1, n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(shingles * a[k] + b[k], bounds[:-1]) >> np.uint64(32)
    return out


def least_matches(threshold: float, tolerance: float, step: int, total: int) -> dict[int, int]:
    """For n values compared, the fewest matches whose posterior is not below the tolerance.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1), whose mass above t is P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(step, total + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, end to end, with their bounds."""
    data, offsets = as_bytes(batch.column("text"))
    hashes, _, bounds = word_hashes(data, offsets)
    runs, run_bounds = shingle_hashes(hashes, bounds)
    own = [np.unique(runs[a:b]) for a, b in zip(run_bounds[:-1], run_bounds[1:])]
    sizes = np.array([len(x) for x in own], np.int64)
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, lo, hi, bands): size and 128-bit sum of the shingle set of rows (doc_id, mark, text), and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shingles, bounds = sets_of(part)
                sizes = np.diff(bounds)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(s)))]) for s in (0x51ED270B, 0xC2B2AE35)]
                lo, hi = ((x[bounds[1:]] - x[bounds[:-1]]).astype(np.uint64).view(np.int64) for x in sums)
                full = np.flatnonzero(sizes > 0)
                keys = np.zeros((len(full), BANDS), np.uint64)
                if len(full):
                    values = min_hashes(shingles, np.append(bounds[:-1][full], bounds[-1]), BANDS * ROWS).astype(np.uint64)
                    for band in range(BANDS):
                        key = np.full(len(full), band + 1, np.uint64)
                        for r in range(ROWS):
                            key = mix(key * np.uint64(0x9FB21C651E98DF25) + values[:, band * ROWS + r])
                        keys[:, band] = key
                counts = np.where(sizes > 0, BANDS, 0)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "mark": part.column("mark"),
                        "n": pa.array(sizes, pa.int64()),
                        "lo": pa.array(lo, pa.int64()),
                        "hi": pa.array(hi, pa.int64()),
                        "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
                    }
                )

    return docs.mapInArrow(run, "doc_id long, mark long, n long, lo long, hi long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, shingles): the exact set of rows (doc_id, mark, text) as sorted 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shingles, bounds = sets_of(part)
                raw = pa.py_buffer(np.ascontiguousarray(shingles, "<u8").tobytes())
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), raw])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "shingles": column.cast(pa.binary())})

    return docs.mapInArrow(run, "doc_id long, mark long, shingles binary")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, limits: dict[int, int], earlier: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (from ``left`` x ``right``, i < j where both are in both) at or above the threshold, tile by tile.

    ``earlier`` has each set's keys of earlier bands; pairs that share one are left to it.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    values = min_hashes(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), COMPARED, seed=2)
    num, den = THRESHOLD
    same = left is right
    for p in range(0, len(left), TILE):
        for q in range(p if same else 0, len(right), TILE):
            rows, cols = left[p : p + TILE], right[q : q + TILE]
            low, high = np.minimum(sizes[rows][:, None], sizes[cols]), np.maximum(sizes[rows][:, None], sizes[cols])
            keep = low * den >= high * num
            if same and p == q:
                keep &= np.arange(len(rows))[:, None] < np.arange(len(cols))
            i, j = np.nonzero(keep)
            i, j = rows[i], cols[j]
            matches = np.zeros(len(i), np.int64)
            for n in range(STEP, COMPARED + 1, STEP):
                if not len(i):
                    break
                matches += (values[i, n - STEP : n] == values[j, n - STEP : n]).sum(axis=1)
                on = matches >= limits[n]
                i, j, matches = i[on], j[on], matches[on]
            if earlier is not None:
                fresh = ~(earlier[i] == earlier[j]).any(axis=1)
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            shared = exact_shared(sets, i, j)
            on = shared * (num + den) >= num * (sizes[i] + sizes[j])
            yield i[on], j[on]


def exact_shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of common shingles of each pair."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    # many pairs among few sets: count over the shingles that more than one of them has
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, word, often = np.unique(flat, return_inverse=True, return_counts=True)
    on = often[word] > 1
    shared_words, word = np.unique(word[on], return_inverse=True)
    owner = owner[on]
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for start in range(0, len(shared_words), 4096):
        a, b = np.searchsorted(word, [start, start + 4096])
        table = np.zeros((len(rows), min(4096, len(shared_words) - start)), np.float32)
        table[owner[a:b], word[a:b] - start] = 1
        total += table @ table.T
    return total[back[: len(i)], back[len(i) :]].astype(np.int64)


def compare_blocks(work: DataFrame) -> DataFrame:
    """(cls, links, root) from rows (*UNIT, level, block, cls, mult, bands, shingles) that stand unit by unit."""
    limits = least_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE, STEP, COMPARED)

    def group(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        rep = whole.column("cls").to_numpy()
        level, block, mult = (whole.column(c).to_numpy() for c in ("level", "block", "mult"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in whole.column("shingles")]
        one, two = ((whole.column(f"l{k}")[0].as_py(), whole.column(f"b{k}")[0].as_py()) for k in (1, 2))
        left = np.flatnonzero((level == one[0]) & (block == one[1]))
        right = left if one == two else np.flatnonzero((level == two[0]) & (block == two[1]))
        links = np.zeros(len(rep), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        band = whole.column("band")[0].as_py()
        earlier = whole.column("bands").flatten().to_numpy().reshape(len(rep), -1)[:, :band] if band >= 0 else None
        for i, j in linked_pairs(sets, left, right, limits, earlier) if len(left) and len(right) else ():
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            ends.append((i, j))
        if not ends:
            return None
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        label = forest(len(rep), *(place[np.concatenate(x)] for x in zip(*ends)))
        root = rep[order][label][place]
        on = links > 0
        return pa.record_batch({"cls": pa.array(rep[on]), "links": pa.array(links[on]), "root": pa.array(root[on])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in UNIT])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[:, a])
                if at is not None and key != at:
                    if (out := group(held)) is not None:
                        yield out
                    held = []
                at = key
                held.append(batch.slice(a, b - a))
        if held and (out := group(held)) is not None:
            yield out

    return work.mapInArrow(run, "cls long, links long, root long")


#: What a task's unit of work is known by: two blocks of a cluster (or of the bucket of a band), each of a level of sizes.
UNIT = ["cluster", "band", "l1", "b1", "l2", "b2"]


def blocks_of(sets: DataFrame) -> DataFrame:
    """(cluster, band, size, level, here, above, below, rows, small): blocks of each level of sizes, and of its neighbours, of sets (cluster, band, size, bytes)."""
    sizes = settle(sets.groupBy("cluster", "band", "size").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")), "levels")
    # a row for each cluster and level
    whole = sizes.groupBy("cluster", "band").agg(F.sum("rows").alias("all_rows"), F.sum("bytes").alias("all_bytes")).where("all_rows > 1")
    sizes = sizes.join(whole, ["cluster", "band"]).withColumn("small", (F.col("all_rows") <= BLOCK_ROWS) & (F.col("all_bytes") <= BLOCK_BYTES))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = sizes.select("cluster", "band", "size", F.when(F.col("small"), 0).otherwise(F.col("size")).alias("level"), F.when(F.col("small"), 1).otherwise(blocks).alias("here"), "rows", "small")
    for name, step in (("above", 1), ("below", -1)):
        other = sizes.where("NOT small").select("cluster", "band", (F.col("size") - step).alias("size"), F.col("here").alias(name))
        sizes = sizes.join(other, ["cluster", "band", "size"], "left")
    return settle(sizes.na.fill(0, ["above", "below"]), "blocks")


def cut(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (*UNIT, level, block, cls, mult, bands, shingles): each set in every unit that its block is part of.

    A cluster of one block is one unit.  A larger one is cut by levels of set sizes, and a
    level into blocks; a block meets the blocks of its own level and of the next.
    """
    sizes = sizes.drop("rows", "small")
    dealt = sets.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LEVELS else sizes, ["cluster", "band", "size"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("here")).cast("int"))
    at, own = F.col("level"), F.col("block")

    def each(count: str, unit) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1), lambda o: o < F.col(count)), unit)

    def pair(l1: Column, b1: Column, l2: Column, b2: Column) -> Column:
        return F.struct(*[c.cast("int").alias(n) for n, c in zip(UNIT[2:], (l1, b1, l2, b2))])

    every = F.concat(
        each("here", lambda o: pair(at, F.least(own, o), at, F.greatest(own, o))),
        each("above", lambda o: pair(at, own, at + 1, o)),
        each("below", lambda o: pair(at - 1, o, at, own)),
    )
    return dealt.withColumn("unit", F.explode(every)).select("cluster", "band", "unit.*", "level", "block", "cls", "mult", "bands", "shingles")


def by_buckets(whole: Column, buckets: Column) -> Column:
    """Whether a cluster's buckets make fewer copies of its sets than its blocks."""
    return buckets < whole


def units(sets: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows (*UNIT, level, block, cls, mult, bands, shingles) of all pairs that are to be compared, each pair in one unit.

    sets: cls, cluster, mult, bytes, shingles; bands: cls, bands (the keys of all bands).
    """
    size = F.floor(F.log(F.col("bytes") / 8) / F.log(F.lit(LEVEL_BASE))).cast("int")
    levelled = sets.withColumns({"size": size, "band": F.lit(-1), "bands": F.lit(None).cast("array<long>")})
    sizes = blocks_of(levelled.select("cluster", "band", "size", "bytes"))
    copies = F.sum(F.col("rows") * (F.col("here") + F.col("above") + F.col("below")))
    large = settle(sizes.where("NOT small").groupBy("cluster").agg(copies.alias("whole")), "large")
    if large.isEmpty():
        return cut(levelled, sizes)
    slim = levelled.select("cls", "cluster", "size", "bytes").join(large.select("cluster"), "cluster", "left_semi")
    held = slim.join(bands, "cls").select("cls", F.col("cluster").alias("closure"), "size", "bytes", F.posexplode("bands").alias("band", "cluster"))
    held = settle(held, "buckets")
    bucket_sizes = blocks_of(held.select("cluster", "band", "size", "bytes"))
    # a bucket lies in one closure
    owner = held.groupBy("cluster", "band").agg(F.min("closure").alias("closure"))
    cost = bucket_sizes.groupBy("cluster", "band").agg(copies.alias("copies")).join(owner, ["cluster", "band"]).groupBy("closure").agg(F.sum("copies").alias("buckets"))
    chosen = large.join(cost, large["cluster"] == cost["closure"]).where(by_buckets(F.col("whole"), F.col("buckets"))).select("cluster")
    chosen = settle(chosen, "by-buckets")
    closures = cut(levelled.join(chosen, "cluster", "left_anti"), sizes)
    if chosen.isEmpty():
        return closures
    met = bucket_sizes.select("cluster", "band").distinct()
    own = held.join(chosen.withColumnRenamed("cluster", "closure"), "closure", "left_semi").join(met, ["cluster", "band"], "left_semi").select("cls", "cluster", "band", "size")
    full = own.join(sets.select("cls", "mult", "shingles"), "cls").join(bands, "cls")
    return closures.unionByName(cut(full, bucket_sizes))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): rows and a hash of their text, which tells rows of one id apart."""
    return columns(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))


def near_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): each row's class, and each linked class's links and component.

    members: doc_id, mark, cls, first (least doc_id and mark of the class), mult (rows in it).
    links: cls, links (rows of other classes linked with it), least (least first of the component).
    """
    with batch_rows(docs.sparkSession, 1000):
        return _near_join(marked(docs))


def _near_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    prints = settle(fingerprints(docs), "prints")
    usable = prints.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("lo", "hi").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("mult"))
    # numbers need only differ; they are written once
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = settle(usable.select("doc_id", "mark", "lo", "hi").join(classes, ["lo", "hi"]).select("doc_id", "mark", "cls", "first", "mult"), "members")

    firsts = usable.join(classes.select("lo", "hi", "cls", "first.doc_id", "first.mark"), ["lo", "hi", "doc_id", "mark"])
    bands = firsts.select("cls", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("cls").alias("least"), F.max("cls").alias("last")).where("least <> last").select("band", "least")
    stars = bands.join(buckets, "band").where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"))
    clusters = components(stars).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))

    wanted = settle(clusters.join(classes, "cls").select("cls", "cluster", "mult", "first.doc_id", "first.mark"), "wanted")
    texts = docs.join(wanted.select("doc_id", "mark"), ["doc_id", "mark"], "left_semi")
    sets = shingle_sets(texts).dropDuplicates(["doc_id", "mark"])
    sets = settle(sets.join(wanted, ["doc_id", "mark"]).where(F.length("shingles") > 0).select("cls", "cluster", "mult", F.length("shingles").alias("bytes"), "shingles"), "sets")
    work = units(sets, firsts.select("cls", "bands")).repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = settle(compare_blocks(work), "found")

    linked = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    least = linked.join(classes.select("cls", "first"), "cls").groupBy("component").agg(F.min("first").alias("least"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    return members, settle(counts.join(linked.join(least, "component"), "cls").select("cls", "links", "least"), "linked")


def annotate(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, component_id, n_links, kept) of every row of ``docs``.

    class_id: least doc_id with the same shingle set; component_id: least doc_id that links
    lead to; n_links: other rows at the threshold or above, copies included; kept: whether
    the row stands for its component.
    """
    members, links = near_join(docs)
    least = F.coalesce("least", "first")
    joined = members.join(links, "cls", "left").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        least["doc_id"].alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        (F.struct("doc_id", "mark") == least).alias("kept"),
    )
    # rows without a shingle or without an id stand for themselves
    alone = columns(docs, doc_id="long", text="string").where("doc_id IS NULL OR coalesce(text, '') NOT RLIKE '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least doc_id (of rows that repeat it, the least by a hash of the text).

    Rows without a shingle or without an id stay.
    """
    members, links = near_join(docs)
    settled = settle(members.join(links, "cls", "left").select("doc_id", "mark", F.coalesce("least", "first").alias("least")), "standing")
    gone = settled.where(F.struct("doc_id", "mark") != F.col("least")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    names = {c.lower(): c for c in docs.columns}
    own_id, own_mark = docs[names["doc_id"]].cast("long"), F.xxhash64(docs[names["text"]].cast("string"))
    left = docs.join(gone, (own_id == F.col("__id")) & (own_mark == F.col("__mark")), "left_anti")
    # rows that repeat id and text are one; those alone are shuffled
    twice = settled.where(F.struct("doc_id", "mark") == F.col("least")).groupBy("doc_id", "mark").count().where("count > 1")
    twice = settle(twice.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "repeated")
    if twice.isEmpty():
        return left
    same = (left[names["doc_id"]].cast("long") == F.col("__id")) & (F.xxhash64(left[names["text"]].cast("string")) == F.col("__mark"))
    repeated = left.join(twice, same, "left_semi").dropDuplicates([names["doc_id"], names["text"]])
    return left.join(twice, same, "left_anti").unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
_RUNS = "unnest(list_transform(range(1, CASE WHEN len(w) >= 5 THEN len(w) - 3 WHEN len(w) > 0 THEN 2 ELSE 1 END), lambda i: array_to_string(w[i:i + 4], ' ')))"
#: Exact Jaccard similarities of all pairs that share a shingle, and the transitive closure of the links.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS MATERIALIZED (SELECT DISTINCT doc_id, {_RUNS} AS run FROM d),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS size FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS common FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y, common = p.size AND common = q.size AS same FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE common * {sum(THRESHOLD)} >= {THRESHOLD[0]} * (p.size + q.size)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON x = r.other),
least AS (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id),
own AS (SELECT x AS doc_id, COUNT(*) AS n_links, MIN(CASE WHEN same THEN y END) AS twin FROM links GROUP BY x)
SELECT doc_id, LEAST(doc_id, COALESCE(twin, doc_id)) AS class_id, component_id, COALESCE(n_links, 0)::BIGINT AS n_links, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN own USING (doc_id)
"""
