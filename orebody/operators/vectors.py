"""Top-k of many query vectors over a written index.

The index holds the distinct vectors in inverted lists: each unit vector belongs to its
nearest coarse centroid, and the rest is a product-quantised code of one byte for each part,
beside the length of what the code leaves out and the unit vector in single precision.  A search
of some lists scans codes, not vectors: each task looks distances up in tables made from the
queries, keeps a bounded heap for each query, and passes on what the heap does not exclude; the
tasks' heaps are merged and what is left is ranked by its exact cosine.

With all lists probed the result is exact: lists are excluded where centroid and radius say so,
and the others' vectors by products in single precision and the bound of their rounding.  With ``probes`` lists a query, recall is what the lists hold; the
heap then has ``REFINE`` times k entries.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors by a hash of
their numbers); every vector is indexed.  A group of equal vectors is one entry, with its keys in a table
of its own, so that copies never fill a heap; lists are cut by ranges of (list, hash), so that
a list with a third of all vectors is many tasks.  Queries are a stated set, broadcast in
blocks of at most ``QUERY_BYTES``.

Vectors that are null, zero, or hold null or non-finite numbers are not indexed and never
found; such queries, and queries of another length, have no row.  Equal similarities are
ordered by key; rows that repeat a key are found one by one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.functions.expressions import cosine
from orebody.operators.running import running
from orebody.sources.scratch import settle

#: Vectors that centroids and codebooks are fitted on, and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Numbers in a part of a code, and words of a codebook (a byte).
PART, WORDS = 8, 256
MOST_LISTS = 4096
#: Approximate search re-ranks so many times k vectors a query.
REFINE = 10
#: Bytes of queries and their tables in one broadcast.
QUERY_BYTES = 32_000_000
#: What looked-up sums of single precision may be off by.
ROUNDING = 1e-5
CHUNK = 1024


class Index(NamedTuple):
    """codes: list, h1, h2, code, rest, unit; groups: h1, h2, vector; members: h1, h2, key; model: one row of bytes."""

    codes: DataFrame
    groups: DataFrame
    members: DataFrame
    model: DataFrame


class Model(NamedTuple):
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray
    radius: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, length left out, distance of the coded vector from its centroid) of unit vectors."""
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        code = np.stack([nearest(rest[:, a:b], book) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:])], axis=1).astype(np.uint8)
        coded = np.concatenate([book[code[:, m]] for m, book in enumerate(self.books)], axis=1)
        return own, code, np.linalg.norm(rest - coded, axis=1), np.linalg.norm(coded, axis=1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, cuts=self.cuts, radius=self.radius, **{f"book{m}": b for m, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        held = np.load(io.BytesIO(raw))
        return cls(held["centroids"], [held[f"book{m}"] for m in range(len(held["cuts"]) - 1)], held["cuts"], held["radius"])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmax(x[a : a + 4096] @ centres.T - half, axis=1)
    return out


def k_means(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """At most k centres; a centre without a point moves to the point that is farthest from its own."""
    r = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[r.choice(len(distinct), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        empty = np.flatnonzero(~full)
        if len(empty):
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1))[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def fit(sample: np.ndarray, lists: int) -> Model:
    centroids = k_means(sample, lists)
    rest = sample - centroids[nearest(sample, centroids)]
    d = sample.shape[1]
    cuts = np.unique(np.append(np.arange(0, d, PART), d))
    books = [k_means(rest[:, a:b], WORDS, seed=m + 2) for m, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    return Model(centroids, books, cuts, np.zeros(len(centroids)))


def sound(vector: Column) -> Column:
    """Whether a vector has a direction."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def in_range(vector: Column) -> Column:
    """A vector of the same direction whose squares are numbers; one of ordinary size as it is."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.when(most.between(1e-100, 1e100), vector).otherwise(F.transform(vector, lambda x: x / most))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows of double precision; scaled first, so that no square overflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(vectors: DataFrame, key: str, column: str, lists: int | None = None) -> Index:
    """Index of a table with a key and an array of numbers; vectors of the commonest length are indexed."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector")).where(sound(F.col("vector"))).withColumn("vector", in_range(F.col("vector")))
    own = own.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    groups = settle(own.groupBy("h1", "h2").agg(F.first("vector").alias("vector")), "vector-groups")
    members = settle(own.select("h1", "h2", "key"), "vector-members")
    lengths = groups.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    if not lengths:
        empty = spark.createDataFrame([], "list int, h1 long, h2 long, code binary, rest float, unit binary")
        return Index(empty, groups, members, spark.createDataFrame([], "model binary"))
    d, n = lengths[0]["d"], lengths[0]["n"]
    groups = groups.where(F.size("vector") == d)
    # the sample is bounded, and its order is a hash of the vectors themselves
    sample = unit_rows(groups.orderBy("h1", "h2").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks())
    model = fit(sample, lists or max(1, min(MOST_LISTS, round(n**0.5))))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(batch.column("vector"))
                place, code, rest, far = own.encode(unit)
                yield pa.record_batch(
                    {
                        "list": pa.array(place, pa.int32()),
                        "h1": batch.column("h1"),
                        "h2": batch.column("h2"),
                        "code": pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary()),
                        "rest": pa.array(np.nextafter(rest.astype(np.float32), np.float32(9)), pa.float32()),
                        "far": pa.array(far, pa.float64()),
                        "unit": pa.array([row.tobytes() for row in unit.astype("<f4")], pa.binary()),
                    }
                )

    coded = groups.select("h1", "h2", "vector").mapInArrow(run, "list int, h1 long, h2 long, code binary, rest float, far double, unit binary")
    coded = settle(coded.repartitionByRange("list", "h1").sortWithinPartitions("list", "h1"), "vector-codes")
    radius = model.radius.copy()
    # a row for each list
    for r in coded.groupBy("list").agg(F.max(F.col("far") + F.col("rest")).alias("radius")).collect():
        radius[r["list"]] = r["radius"]
    held.destroy()
    written = spark.createDataFrame([(bytearray(model._replace(radius=radius).dump()),)], "model binary")
    return Index(coded.drop("far"), groups, members, settle(written, "vector-model"))


def save(index: Index, path: str) -> None:
    for name, part in index._asdict().items():
        part.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in Index._fields])


class _Heaps:
    """For each query the best lower bounds so far, and what they do not exclude."""

    def __init__(self, queries: int, k: int):
        self.best = np.full((queries, k), -np.inf, np.float32)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size = self.limit = 0

    def least(self) -> np.ndarray:
        return self.best[:, 0]

    def add(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """Bounds [len(rows), n] of the queries ``rows`` for n vectors; -inf where a query does not look."""
        k = self.best.shape[1]
        both = np.concatenate([self.best[rows], low], axis=1)
        at = both.shape[1] - k
        both.partition(at, axis=1)
        top = both[:, at:]
        top.sort(axis=1)
        self.best[rows] = top
        q, v = np.nonzero((high >= self.least()[rows][:, None]) & (high > -np.inf))
        if len(q):
            self.kept.append((rows[q], low[q, v], high[q, v], h1[v], h2[v]))
            self.size += len(q)
            if self.size > max(1_000_000, 2 * self.limit):
                self.shrink()

    def shrink(self) -> None:
        if self.kept:
            q, low, high, h1, h2 = (np.concatenate(x) for x in zip(*self.kept))
            on = high >= self.least()[q]
            self.kept = [(q[on], low[on], high[on], h1[on], h2[on])]
            self.size = self.limit = int(on.sum())


def _scan(codes: DataFrame, held, k: int, probes: int | None) -> DataFrame:
    """(query, low, high, h1, h2): in each task, what the heaps of the queries do not exclude.

    An exact search takes products of the vectors themselves, in single precision with its bound
    of rounding: the bounds of codes would pass on a great part of all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, queries = held.value
        model = Model.load(raw)
        q = queries.astype(np.float32)
        exact = probes is None
        tables = [] if exact else [q[:, a:b] @ book.astype(np.float32).T for book, a, b in zip(model.books, model.cuts[:-1], model.cuts[1:])]
        base = q @ model.centroids.astype(np.float32).T
        off = np.float32(max(ROUNDING, (q.shape[1] + 4) * 2.0**-23))
        looks = np.ones(base.shape, bool)
        if not exact and probes < base.shape[1]:
            # queries look into their nearest lists
            apart = base - (model.centroids.astype(np.float32) ** 2).sum(axis=1) / 2
            looks[:] = False
            np.put_along_axis(looks, np.argpartition(-apart, probes - 1, axis=1)[:, :probes], True, axis=1)
        heaps = _Heaps(len(q), k)
        for batch in batches:
            lists = batch.column("list").to_numpy()
            if not len(lists):
                continue
            if exact:
                unit = np.frombuffer(b"".join(batch.column("unit").to_pylist()), "<f4").reshape(len(lists), -1)
            else:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(lists), -1)
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = lists[a]
                rows = np.flatnonzero(looks[:, own] & (base[:, own] + model.radius[own] + off >= heaps.least()))
                for s in range(a, b if len(rows) else a, CHUNK):
                    e = min(b, s + CHUNK)
                    if exact:
                        seen = q[rows] @ unit[s:e].T
                        # most queries have better ones than all of these
                        on = np.flatnonzero(seen.max(axis=1) + off >= heaps.least()[rows])
                        if len(on):
                            seen = seen[on]
                            heaps.add(rows[on], seen - off, seen + off, h1[s:e], h2[s:e])
                        continue
                    seen = np.repeat(base[rows, own][:, None], e - s, axis=1)
                    for m, table in enumerate(tables):
                        seen += table[rows][:, code[s:e, m]]
                    heaps.add(rows, seen, seen, h1[s:e], h2[s:e])
        heaps.shrink()
        for part in heaps.kept:
            yield pa.record_batch({"query": pa.array(part[0], pa.int32()), "low": pa.array(part[1].astype(np.float64)), "high": pa.array(part[2].astype(np.float64)), "h1": pa.array(part[3]), "h2": pa.array(part[4])})

    return codes.select("list", "h1", "h2", "unit" if probes is None else "code").mapInArrow(run, "query int, low double, high double, h1 long, h2 long")


def top_k(index: Index, queries: DataFrame, key: str, column: str, k: int, probes: int | None = None) -> DataFrame:
    """(query, rank, key, similarity) of the k most similar vectors of each query; exact where ``probes`` is None."""
    spark = queries.sparkSession
    models = index.model.collect()
    asked = queries.select(F.col(key).alias("query_key"), F.col(column).cast("array<double>").alias("vector")).where(sound(F.col("vector"))).withColumn("vector", in_range(F.col("vector")))
    kind = dict(queries.dtypes)[key]
    member_kind = dict(index.members.dtypes)["key"]
    out: DataFrame | None = None
    if models:
        model = Model.load(bytes(models[0]["model"]))
        d = model.centroids.shape[1]
        most = max(1, QUERY_BYTES // (4 * (d + len(model.centroids) * 3 + WORDS * len(model.books))))
        asked = asked.where(F.size("vector") == d).withColumn("h", F.xxhash64("query_key", "vector"))
        asked = settle(running(asked, [F.col("h").asc(), F.col("query_key").asc(), F.col("vector").asc()]).withColumn("block", F.floor(F.col("number") / most)).drop("h"), "queries")
        blocks = (asked.agg(F.max("block").alias("n")).first()["n"] if not asked.isEmpty() else -1) + 1
        for block in range(blocks):
            part = asked.where(F.col("block") == block).select((F.col("number") - block * most).cast("int").alias("query"), "query_key", "vector")
            rows = part.orderBy("query").toArrow()
            held = spark.sparkContext.broadcast((bytes(models[0]["model"]), unit_rows(rows.column("vector").combine_chunks())))
            found = _ranked(index, part, settle(_scan(index.codes, held, k if probes is None else k * REFINE, probes), "seen"), k, k if probes is None else k * REFINE)
            found = settle(found, "top-k")
            held.destroy()
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query {kind}, rank int, key {member_kind}, similarity double")


def _ranked(index: Index, asked: DataFrame, seen: DataFrame, k: int, deep: int) -> DataFrame:
    """Heaps merged, exact cosines of what is left, keys of equal vectors."""
    order = Window.partitionBy("query").orderBy(F.col("low").desc())
    # of each query the task's best alone are shuffled for this
    least = seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= deep).groupBy("query").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    left = seen.join(least.where(F.col("n") == deep).select("query", "least"), "query", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    vectors = left.select("query", "h1", "h2").join(index.groups, ["h1", "h2"]).withColumnRenamed("vector", "own")
    scored = vectors.join(asked.select("query", "query_key", "vector"), "query").select("query", "query_key", "h1", "h2", cosine(F.col("own"), F.col("vector")).alias("similarity"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc()))).where(F.col("n") <= deep)
    # vectors of equal cosines beyond the k-th may have smaller keys
    edge = best.where(F.col("n") <= k).groupBy("query").agg(F.min("similarity").alias("edge"))
    best = scored.join(edge, "query").where(F.col("similarity") >= F.col("edge")).drop("edge")
    wanted = settle(best, "nearest-groups")
    # no more than k keys of a group can be needed
    first = index.members.join(wanted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("key").asc_nulls_last()))).where(F.col("n") <= k).drop("n")
    keyed = wanted.join(first, ["h1", "h2"])
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col("key").asc_nulls_last()))
    return keyed.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query_key").alias("query"), F.col("rank").cast("int").alias("rank"), "key", "similarity")
