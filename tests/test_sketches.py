"""Sketches against exact counts and quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from orebody.operators import sketches

LEVELS = [("area", "field"), ("area",), ()]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = [(f"a{k % 3}", f"f{k % 11}", r.randint(0, 4000), r.choice([None, 0.0, float("nan"), r.uniform(-5, 5), r.lognormvariate(3, 4), -r.lognormvariate(0, 9)])) for k in range(20000)]
    rows += [("empty", "x", None, None)]
    return rows, spark.createDataFrame(rows, "area string, field string, id int, v double")


def test_distinct_counts_are_within_their_bound(table):
    rows, base = table
    for keys, level in zip(LEVELS, sketches.distinct_levels(base, "id", LEVELS)):
        for r in sketches.distinct_estimates(level).collect():
            own = {x[2] for x in rows if x[2] is not None and all(r[k] == x[("area", "field").index(k)] for k in keys)}
            assert abs(r["distinct"] - len(own)) <= sketches.distinct_error() * len(own) + 1


def test_quantiles_are_within_their_accuracy(table):
    rows, base = table
    asked = {"least": 0.0, "q10": 0.1, "median": 0.5, "q99": 0.99, "most": 1.0}
    for keys, level in zip(LEVELS, sketches.quantile_levels(base, "v", LEVELS)):
        for r in sketches.quantile_estimates(level, asked).collect():
            own = sorted(x[3] for x in rows if x[3] is not None and x[3] == x[3] and all(r[k] == x[("area", "field").index(k)] for k in keys))
            for name, q in asked.items():
                if not own:
                    assert r[name] is None
                else:
                    exact = own[int(q * (len(own) - 1))]
                    assert abs(r[name] - exact) <= sketches.ACCURACY * abs(exact) * (1 + 1e-9)


def test_levels_merge_what_is_below(table):
    """No level but the first reads the base, and merged quantiles are those of one pass."""
    _, base = table
    levels = sketches.quantile_levels(base, "v", LEVELS)
    direct = sketches.quantile_levels(base, "v", [()])[0]
    assert sorted(map(tuple, levels[-1].select("bucket", "n").collect()), key=str) == sorted(map(tuple, direct.select("bucket", "n").collect()), key=str)
    assert levels[0].count() < base.count()


def test_buckets_keep_the_order_of_values(spark):
    values = [-1e300, -5.0, -1e-300, 0.0, 1e-300, 0.99, 1.0, 1.01, 7e250]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sketches.bucket(F.col("v")).alias("b"))
    rows = rows.withColumn("m", sketches.bucket_value(F.col("b"))).collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert all(abs(r["m"] - r["v"]) <= sketches.ACCURACY * abs(r["v"]) * (1 + 1e-9) for r in rows)


def test_hashed_vectors_equal_the_embedder(spark):
    import numpy as np
    import pandas as pd

    from orebody.operators import search

    texts = ["a b  a\tc", "", None, "Été  ÉTÉ x", "word " * 50, "日本 語"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", search.hashed_vector(F.col("t"), 16).alias("v")).orderBy("k").collect()
    want = search.hashing_embedder(16)(pd.Series(texts))
    assert np.allclose(np.array([r["v"] for r in rows]), want, atol=1e-6)
