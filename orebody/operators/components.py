"""Connected components by contraction.

Every round each node joins the neighbour (or itself) of least random priority and the
edges are contracted to those neighbours; priorities change from round to round, so a
round leaves about half of the nodes whatever the ids or the graph's diameter.  Once no
more than ``SMALL`` edges are left, a single task of that bounded size finds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.sources.scratch import settle

#: Edges that one task takes at most: two ids each, some tens of megabytes.
SMALL = 500_000


def hooked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that the edges (a, b) lead to: roots hook onto smaller ones, then paths are cut short."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := label[label], label):
            label = shorter


def _small(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of at most SMALL edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        a, b = (table.column(c).combine_chunks() for c in ("a", "b"))
        nodes = pc.unique(pa.concat_arrays([a, b]))
        label = hooked(len(nodes), *(pc.index_in(x, nodes).to_numpy(zero_copy_only=False) for x in (a, b)))
        yield pa.record_batch({"node": nodes, "label": nodes.take(pa.array(label))})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.repartition(1).mapInArrow(run, f"node {kind}, label {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); the component is its least node.

    Nulls and loops are dropped; repeated edges count once; no edge gives an empty frame.
    """
    current = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while size := current.count():
        if size <= SMALL:
            maps.append(settle(_small(current), "labels"))
            break
        seed = F.lit(len(maps))
        both = current.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = both.groupBy("node").agg(F.min_by("other", F.struct(F.xxhash64("other", seed), "other")).alias("other"))
        own, that = F.struct(F.xxhash64("node", seed), "node"), F.struct(F.xxhash64("other", seed), F.col("other").alias("node"))
        label = settle(best.select("node", F.when(that < own, F.col("other")).otherwise(F.col("node")).alias("label")), "labels")
        maps.append(label)
        left = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        merged = current.join(left, "a").select("b", "la").join(right, "b")
        current = settle(merged.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "edges")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0]
    for step in maps[1:]:
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    found = settle(found, "roots")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return settle(found.join(least, "label").select("node", "component"), "components")
