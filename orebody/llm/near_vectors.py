"""Near-duplicate vectors by an inverted multi-index.

The two halves of the unit vectors are quantised by codebooks of their own, whose product
is a grid of cells.  A query visits cells in the order of their distance, up to a slack
beyond the nearest one at which the traversals of bounded samples, one of them of vectors
known to have a link, compared with all vectors, reach the target recall, and at which
pairs made right at the threshold reach it; a link counts for both its ends when either
visits the other.  Visited cells are verified by exact cosines in double precision, block
by block.

Equal vectors are one class.  A cell's members and visitors are dealt out in blocks, and
only counts and a spanning forest leave a task.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component
links with nothing; vectors of different lengths do not link; a vector is scaled by its
largest component first, so that no norm leaves the range of doubles; rows that repeat a
vec_id are vectors of their own, compared and counted like all; a row with a null vec_id
is returned unlinked; an empty table gives an empty result.  Columns other than vec_id and
embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.operators.components import components

from .near_join import forest
from .shared import settle

THRESHOLD = 0.95
#: Codebooks are fitted on at most so many vectors, picked by a hash of the id; every vector is indexed.
SAMPLE = 20_000
#: A codebook of more centroids is the sums of a coarse book and one of what that leaves, both fitted on the sample.
FITTED = 256
#: Vectors of a cell aimed at, which sets the number of centroids.
CELL_ROWS = 48
BLOCK = 1024
#: The share of true links, and of pairs at the threshold, that one-way traversals must reach, and the vectors of a sample.
TARGET_RECALL = 0.98
PROBED = 500
SLACK_STEP = 0.005
#: The slack is at least so many steps, whatever the sample shows.
LEAST_STEPS = 6


def normalised(raw: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision from a binary column of equal lengths."""
    x = np.frombuffer(b"".join(raw.to_pylist()), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spread rows; an empty one keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (((centres**2).sum(axis=1)) - 2 * (x @ centres.T)).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return np.unique(centres, axis=0)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * (x @ centres.T), 0)


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) by multi-sequence traversal of both codebooks' sorted distances.

    Cells come in the order of the sum of their halves' squared distances, up to ``slack``
    above the first one.  Along the sorted first distances, the second ones that still fit
    form a shrinking prefix: that staircase is what the traversal has visited when it stops.
    """
    half = x.shape[1] // 2
    first, second = squared(x[:, :half], books[0]), squared(x[:, half:], books[1])
    least_1, least_2 = first.min(axis=1), second.min(axis=1)
    queries, cells = [], []
    for q in range(len(x)):
        near_1 = np.flatnonzero(first[q] <= least_1[q] + slack)
        near_2 = np.flatnonzero(second[q] <= least_2[q] + slack)
        near_1, near_2 = near_1[first[q, near_1].argsort()], near_2[second[q, near_2].argsort()]
        limit = least_1[q] + least_2[q] + slack
        depth = np.searchsorted(second[q, near_2], limit - first[q, near_1], "right")
        i = np.repeat(near_1, depth)
        j = near_2[np.arange(len(i)) - np.repeat(np.cumsum(depth) - depth, depth)]
        # the nearest cell is visited whatever rounding does to the limit
        home = first[q].argmin() * len(books[1]) + second[q].argmin()
        own = np.union1d(i * len(books[1]) + j, [home])
        queries.append(np.full(len(own), q))
        cells.append(own)
    return np.concatenate(queries), np.concatenate(cells)


def beyond_first(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """How far each cell's squared distance lies above that of the row's first cell; a column for each cell."""
    half = x.shape[1] // 2
    first, second = squared(x[:, :half], books[0]), squared(x[:, half:], books[1])
    return first[:, cells // len(books[1])] + second[:, cells % len(books[1])] - (first.min(axis=1) + second.min(axis=1))[:, None]


def threshold_slack(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> float:
    """The slack at which sampled vectors reach the target share of mates right at the threshold.

    A vector's mates lie in a random direction and in that of another sampled vector; the
    worse of the two counts.  It rests on no link of the sample.
    """
    half = x.shape[1] // 2
    slack = 0.0
    for way in (np.random.default_rng(7).normal(size=x.shape), np.roll(x, 1, axis=0)):
        way = way - (way * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(way, axis=1)
        on = size > 1e-9
        if not on.any():
            continue
        mate = THRESHOLD * x[on] + np.sqrt(1 - THRESHOLD**2) * way[on] / size[on, None]
        home = squared(mate[:, :half], books[0]).argmin(axis=1) * len(books[1]) + squared(mate[:, half:], books[1]).argmin(axis=1)
        needed = np.diagonal(beyond_first(x[on], books, home))
        slack = max(slack, float(np.quantile(needed, TARGET_RECALL, method="higher")))
    return slack


def linked_sample(members: DataFrame, code: str) -> pa.Table:
    """(cls, raw) of at most PROBED vectors with a link, however few vectors of the table have one.

    They are looked for among the neighbours in the order of cells, a block at a time, so
    that the pass grows with the table and not with a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                x = normalised(part.column("raw"), code)
                near = x @ x.T >= THRESHOLD
                np.fill_diagonal(near, False)
                yield part.select(["cls", "raw"]).filter(pa.array(near.any(axis=1)))

    own = F.xxhash64("raw")
    dealt = members.select("cell", "cls", "raw").repartitionByRange("cell", own).sortWithinPartitions("cell", own)
    return dealt.mapInArrow(run, "cls long, raw binary").orderBy(F.xxhash64("raw", F.lit("linked")), "raw").limit(PROBED).toArrow()


def calibrate(members: DataFrame, code: str, books: tuple[np.ndarray, np.ndarray]) -> float:
    """The slack at which sampled vectors' traversals reach the target share of their true links.

    Bounded samples, of all vectors and of vectors known to have a link, are compared with
    all vectors, where those are; what comes back is, per sampled vector, a histogram over
    fixed steps of slack.  The slack is never below what pairs at the threshold need.
    """
    chosen = members.orderBy(F.xxhash64("raw", F.lit("calibrate")), "raw").limit(PROBED).select("cls", "raw").toArrow().combine_chunks()
    least = max(LEAST_STEPS, int(np.ceil(threshold_slack(normalised(chosen.column("raw").combine_chunks(), code), books) / SLACK_STEP)))
    known = linked_sample(members, code)
    if len(known):
        chosen = pa.concat_tables([chosen.cast(known.schema), known]).combine_chunks()
    ids, first = np.unique(chosen.column("cls").to_numpy(), return_index=True)
    asked = (ids, normalised(chosen.column("raw").combine_chunks().take(pa.array(first)), code))
    held = members.sparkSession.sparkContext.broadcast((asked, books))  # at most 2 * PROBED vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, x), books = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                near = x @ normalised(part.column("raw"), code).T >= THRESHOLD
                near &= ids[:, None] != part.column("cls").to_numpy()
                i, j = np.nonzero(near)
                home, back = np.unique(part.column("cell").to_numpy()[j], return_inverse=True)
                own = beyond_first(x, books, home)[i, back] if len(i) else np.zeros(0)
                # links are counted here; a group of many copies leaves a row for each step
                pairs, often = np.unique(np.stack([i, np.ceil(np.maximum(own, 0) / SLACK_STEP).astype(np.int64)]), axis=1, return_counts=True)
                yield pa.record_batch({"query": pa.array(pairs[0].astype(np.int32)), "step": pa.array(pairs[1].astype(np.int32)), "links": pa.array(often.astype(np.int64))})

    steps = members.select("cls", "cell", "raw").mapInArrow(run, "query int, step int, links long").groupBy("query", "step").agg(F.sum("links").alias("links")).collect()
    totals: dict[int, int] = {}
    for r in steps:
        totals[r["query"]] = totals.get(r["query"], 0) + r["links"]
    # the target is to be reached where every vector counts alike, and where every link does
    links = sum(totals.values())
    by_vector = by_link = 0.0
    for r in sorted(steps, key=lambda r: r["step"]):
        if min(by_vector, by_link) >= TARGET_RECALL:
            break
        by_vector += r["links"] / totals[r["query"]] / len(totals)
        by_link += r["links"] / links
        least = max(least, r["step"])
    return least * SLACK_STEP


def flagged(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, embedding, sound) of every row, and the numpy type of the components: sound rows can link."""
    have = {f.name.lower(): f for f in vectors.schema.fields}
    kind = have["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = vectors.select(F.col(have["vec_id"].name).cast("long").alias("vec_id"), F.col(have["embedding"].name).cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda c: c != 0)
    return v.withColumn("sound", F.coalesce(sound, F.lit(False))), "<f4" if single else "<f8"


def packed(sound: DataFrame, code: str) -> DataFrame:
    """(vec_id, dim, raw) of sound rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(e.values.to_numpy(), code).tobytes() for e in batch.column("embedding")]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "dim": pa.array([len(r) // np.dtype(code).itemsize for r in raw], pa.int32()), "raw": pa.array(raw, pa.binary())})

    return sound.select("vec_id", "embedding").mapInArrow(pack, "vec_id long, dim int, raw binary")


def book(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; beyond FITTED all sums of two smaller books, so that the sample need not grow with k."""
    if k <= FITTED:
        return k_means(x, k)
    coarse = k_means(x, min(len(x), int(np.ceil(np.sqrt(k)))))
    left = x - coarse[squared(x, coarse).argmin(axis=1)]
    fine = k_means(left, min(len(x), -(-k // len(coarse))))
    return np.unique((coarse[:, None] + fine[None]).reshape(-1, x.shape[1]), axis=0)


def fit_books(vectors: DataFrame, code: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    chosen = vectors.orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).select("raw").toArrow().combine_chunks()
    x = normalised(chosen.column("raw").combine_chunks(), code)
    # the square root of the table's size: cells keep their rows however many vectors there are
    k = min(len(x), max(1, round(np.sqrt(count / CELL_ROWS)))) if count <= FITTED**2 * CELL_ROWS else round(np.sqrt(count / CELL_ROWS))
    half = x.shape[1] // 2
    return book(x[:, :half], k), book(x[:, half:], k)


def compare(work: DataFrame, code: str) -> DataFrame:
    """(cls, links, root) from rows (cell, m, p, visitor, home, visits, cls, mult, raw) that stand group by group.

    ``visits`` holds the cells that a member visits itself.
    """

    def group(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        visitor = whole.column("visitor").to_numpy(zero_copy_only=False)
        cls, mult, home = (whole.column(c).to_numpy() for c in ("cls", "mult", "home"))
        queries, members = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        if not len(queries) or not len(members):
            return None
        x = normalised(whole.column("raw"), code)
        near = (x[queries] @ x[members].T >= THRESHOLD) & (cls[queries][:, None] != cls[members])
        i, j = np.nonzero(near)
        if not len(i):
            return None
        links = np.zeros(len(cls), np.int64)
        np.add.at(links, queries[i], mult[members[j]])
        # a member that does not visit the query's own cell learns of the link here
        own = whole.column("visits").take(pa.array(members))
        known = np.repeat(np.arange(len(members)), own.value_lengths().to_numpy()), own.flatten().to_numpy()
        cells, spot = np.unique(np.concatenate([known[1], home[queries]]), return_inverse=True)
        visited = np.unique(known[0] * len(cells) + spot[: len(known[1])])
        asked = j * len(cells) + spot[len(known[1]) :][i]
        unaware = ~np.isin(asked, visited)
        np.add.at(links, members[j[unaware]], mult[queries[i[unaware]]])
        names, place = np.unique(cls, return_inverse=True)
        label = forest(len(names), place[queries[i]], place[members[j]])
        on = np.flatnonzero(links > 0)
        return pa.record_batch({"cls": pa.array(cls[on]), "links": pa.array(links[on]), "root": pa.array(names[label[place[on]]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "m", "p")])
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


def links_of(classes: DataFrame, code: str) -> DataFrame:
    """(cls, links, root) of the classes (cls, mult, raw) of one length."""
    count = classes.count()
    books = fit_books(classes, code, count)
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast(books)  # two tables of as many rows as the root of the number of cells
    block = max(1, min(BLOCK, 8_000_000 // max(len(b) for b in books)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                part = batch.slice(s, block)
                x = normalised(part.column("raw"), code)
                half = x.shape[1] // 2
                cell = squared(x[:, :half], one).argmin(axis=1) * len(two) + squared(x[:, half:], two).argmin(axis=1)
                yield pa.record_batch({"cell": pa.array(cell.astype(np.int64)), "cls": part.column("cls"), "mult": part.column("mult"), "raw": part.column("raw")})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                part = batch.slice(s, block)
                query, cell = visits(normalised(part.column("raw"), code), held.value, slack)
                bounds = np.searchsorted(query, np.arange(part.num_rows + 1)).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(cell.astype(np.int64)))
                yield pa.record_batch([*part.columns, own], names=[*part.schema.names, "visits"])

    members = settle(classes.select("cls", "mult", "raw").mapInArrow(place, "cell long, cls long, mult long, raw binary"), "cells")
    slack = calibrate(members, code, books)
    # what a vector visits is decided here, once, and read from here by both ends of a pair
    members = settle(members.mapInArrow(probe, "cell long, cls long, mult long, raw binary, visits array<long>"), "visits")
    probes = members.select(F.explode("visits").alias("cell"), "cls", "mult", "raw", F.col("cell").alias("home"))
    cells = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ms"))
    cells = cells.join(probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ps")), "cell")
    cells = settle(cells, "grid")
    # visited cells without members fall away here; the grid has a row for each occupied cell
    visiting = probes.join(cells, "cell").withColumn("visits", F.lit(None).cast("array<long>"))
    own = F.xxhash64("cls")
    visiting = visiting.withColumn("p", F.pmod(own, F.col("ps")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    staying = members.withColumn("home", F.col("cell")).join(cells, "cell")
    staying = staying.withColumn("m", F.pmod(own, F.col("ms")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))
    names = ["cell", "m", "p", "visitor", "home", "visits", "cls", "mult", "raw"]
    work = visiting.withColumn("visitor", F.lit(True)).select(*names).unionByName(staying.withColumn("visitor", F.lit(False)).select(*names))
    return settle(compare(work.repartition("cell", "m", "p").sortWithinPartitions("cell", "m", "p"), code), "links")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    rows, code = flagged(vectors)
    sound = settle(packed(rows.where("sound"), code).withColumn("key", F.sha2("raw", 256)), "vectors")
    classes = sound.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    # numbers need only differ; they are written once
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    ids = sound.select("vec_id", "key").join(classes.select("key", "cls", "rep", "mult"), "key").select("vec_id", "cls", "rep", "mult")
    found = None
    for row in classes.select("dim").distinct().collect():  # the lengths of vectors, not vectors
        own = links_of(classes.where(F.col("dim") == row["dim"]).select("cls", "mult", "raw"), code)
        found = own if found is None else found.unionByName(own)
    if found is None:
        linked = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
        least = roots.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
        counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
        known = counts.join(roots.join(least, "component"), "cls").select("cls", "links", "least")
        linked = ids.join(known, "cls", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    lost = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lost).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Cosines of all pairs, and the transitive closure of the links.
ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, y FROM reach r JOIN links ON x = r.other),
least AS (SELECT vec_id, MIN(other) AS component_id FROM reach GROUP BY vec_id),
own AS (SELECT x AS vec_id, COUNT(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, COALESCE(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN own USING (vec_id)
"""
