"""Work that grows with the tables and not with their square: figures and results of round four's findings."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from orebody.operators import intervals, resolve, rollup, vectors


def test_totals_of_questions_equal_the_rows_asked_for(spark):
    r = random.Random(3)
    names = ["Duri", "Abadi", "Minas", None]
    rows = [(r.choice(names), r.choice(["ROK", "MAS"]), r.choice([2020, 2021, None]), r.choice(["low", "high"]), r.choice(["a", None]), r.choice([1.0, 2.5, None])) for _ in range(400)]
    table = spark.createDataFrame(rows, "field_name string, wk_name string, report_year int, uncert_level string, project_class string, v double")
    asked = [(k, r.choice([*names[:3], "none"]) if k % 2 else r.choice(["ROK", "MAS"]), "field_name" if k % 2 else "wk_name", r.choice([2020, None]), r.choice(["low", None]), r.choice(["a", None])) for k in range(60)]
    asked += [(99, None, None, None, None, None), (1, "MAS", "wk_name", None, None, None)]
    asked = spark.createDataFrame(asked, "k int, name string, filter_column string, year int, level string, class string")
    plain = resolve.rows_asked_for(asked, "k", table).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    totals = resolve.totals_asked_for(asked, "k", table, "v")
    assert sorted(tuple(x) for x in totals.collect()) == sorted(tuple(x) for x in plain.collect())
    # no operator sees a row for each question: questions and rows meet as distinct requests and sums
    assert totals.count() > 40


def test_rows_of_questions_meet_sums(spark):
    from orebody.plans.catalogue import QUERIES

    plan = QUERIES["rows_of_questions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[0]
    assert "sum(n" in above and "count(1)" not in above


def test_rows_of_questions_leave_names_with_the_digits_of_a_year(spark, tmp_path):
    from orebody.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    # customers beyond those of sf0.1: fields 19970, 199725 and 20970, which 19970 would be with its digits replaced, and 1997 with a question about its area
    con.execute("CREATE TABLE customer AS SELECT k AS c_custkey, 'Customer#' || lpad(k::VARCHAR, 9, '0') AS c_name, 22 AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'FURNITURE' AS c_mktsegment FROM unnest([19970::BIGINT, 199725, 20970, 1997]) t(k)")
    con.execute("CREATE TABLE orders AS SELECT k + i AS o_orderkey, k AS o_custkey, 'F' AS o_orderstatus, k + i / 4 AS o_totalprice, TIMESTAMP '1997-05-01' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM unnest([19970::BIGINT, 199725, 20970, 1997]) t(k), range(6) s(i)")
    for t in ("nation", "region"):
        con.execute(f"CREATE TABLE {t} AS FROM '/root/testdata/sf0.001/{t}.parquet'")
    for t in ("customer", "orders", "nation", "region"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = sorted(con.execute(ORACLES["rows_of_questions"]).fetchall())
    assert [k for k, *_ in want] == [1997, 19970, 20970, 199725]
    got = QUERIES["rows_of_questions"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("c_custkey", "n", "rec_oc").collect()) == want


def test_overlaps_of_few_rows_a_key_are_not_cut_into_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, r.choice([*range(40), *[7] * 9, None]), r.choice([None, r.randint(0, 90)]), r.choice([None, r.randint(20, 110)])) for k in range(400)]
    x = spark.createDataFrame(rows, "i int, g int, a int, b int")
    y = x.toDF("j", "g", "c", "d")
    full = lambda v: (-(10**9) if v[2] is None else v[2], 10**9 if v[3] is None else v[3])
    want = []
    for p in rows:
        for q in rows:
            (a, b), (c, d) = full(p), full(q)
            if p[1] is not None and p[1] == q[1] and a <= b and c <= d and a <= d and c <= b:
                want.append((p[0], q[0]))
    for few in (10_000, 12, 0):
        monkeypatch.setattr(intervals, "FEW", few)
        found = intervals.overlaps(x, y, ("a", "b"), ("c", "d"), ["g"])
        assert sorted(tuple(o) for o in found.select("i", "j").collect()) == sorted(want)
        if few == 10_000:
            assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rollups_sort_texts_alone(spark):
    r = random.Random(5)
    level = rollup.Level(("a", "b"), ("t", "low"), ("u",), tuple(f"m{k}" for k in range(rollup.WIDE)), counts={"named": "t"}, rows="n", remarks={"all": ("t", "u")})
    rows = [(r.choice([1, 2, None]), r.choice(["x", None]), r.choice(["p", "q", "", None]), r.choice(["s", None]), r.choice([1, 5, None]), *[r.choice([1.0, 2.0, None])] * rollup.WIDE) for _ in range(200)]
    frame = spark.createDataFrame(rows, "a int, b string, t string, u string, low int, " + ", ".join(f"{m} double" for m in level.sums))
    got = rollup.roll_up(frame, level, "t,u")
    plan = got._jdf.queryExecution().executedPlan().toString()
    sorted_parts = [x for x in plan.splitlines() if "SortAggregate" in x or "ObjectHashAggregate" in x]
    assert sorted_parts and not any("sum(" in x for x in sorted_parts)
    narrow = rollup.Level(level.keys, level.least, level.greatest, level.sums[:1], counts=level.counts, rows="n", remarks=level.remarks)
    same = ["a", "b", "t", "low", "u", "m0", "named", "n", "all"]
    key = lambda x: str(tuple(x))
    assert sorted(got.select(*same).collect(), key=key) == sorted(rollup.roll_up(frame, narrow, "t,u").select(*same).collect(), key=key)


def test_exact_search_passes_on_few_vectors(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(3000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = vectors.build(frame, "id", "v")
    seen = {}
    whole = vectors._ranked

    def ranked(index, asked, found, k, deep):
        seen["rows"], seen["tasks"] = found.count(), found.rdd.getNumPartitions()
        return whole(index, asked, found, k, deep)

    monkeypatch.setattr(vectors, "_ranked", ranked)
    got = vectors.top_k(index, frame.where("id % 50 = 0"), "id", "v", 10)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {(q, int(k)) for q in range(0, 3000, 50) for k in np.argsort(-(unit @ unit[q]))[:10]}
    assert {(r["query"], r["key"]) for r in got.collect()} == best
    # a heap's worth of each task, not a share of the 60 x 3,000 pairs
    assert seen["rows"] <= 60 * 11 * 8
