"""Coarsest levels, interval joins, phrases, rejected input and upserts of a stream against plain definitions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from orebody.functions.vocabulary import snapshot_schema
from orebody.operators import intervals, lattice, phrases
from orebody.sources import files
from orebody.streaming import upserts

# ------------------------------------------------------------------ lattice


def held(spark):
    r = random.Random(1)
    rows = [(r.choice([2020, 2021, None]), r.choice("abc"), r.choice("xyz"), r.choice([None, 1.0, 2.0, 5.0])) for _ in range(300)]
    base = spark.createDataFrame(rows, "year int, area string, field string, v double")
    return base, lattice.build(base, {"fine": (("year", "area", "field"), ("v",)), "area": (("year", "area"), ("v",)), "year": (("year",), ("v",)), "bare": (("area",), ())})


def test_levels_are_built_from_each_other_and_cover(spark):
    _, levels = held(spark)
    by = {s.name: s for s in levels}
    assert by["year"].rows == 3 and by["area"].rows == 9 and by["fine"].rows == 27
    ask = lambda *a: lattice.choose(levels, lattice.Request("q", *a)).name
    assert ask(("year",), "avg", "v") == "year"
    assert ask(("area",), "sum", "v") == "area"  # the level by area has no measure
    assert ask(("area",), "rows") == "bare"
    assert ask((), "sum", "v", (lattice.Filter("field", "=", ("x",)),)) == "fine"
    assert ask(("year",), "distinct", "field") == "base"
    for wrong in ((("nothing",), "rows"), (("year",), "median", "v")):
        with pytest.raises(ValueError):
            ask(*wrong)


def test_answers_equal_the_base(spark):
    base, levels = held(spark)
    tests = [(), (lattice.Filter("year", "=", (2020,)),), (lattice.Filter("year", "null"), lattice.Filter("area", "in", ("a", "b"))), (lattice.Filter("year", "between", (2021, 2022)),), (lattice.Filter("area", "=", ("nowhere",)),)]
    requests = [lattice.Request(f"{kind} {keys} {n}", keys, kind, None if kind == "rows" else "v", t) for kind in lattice.KINDS for keys in ((), ("year",), ("area", "year")) for n, t in enumerate(tests)]
    got = sorted((r["request"], r["group"], r["value"]) for r in lattice.answer(levels, requests).collect())
    want = sorted((r["request"], r["group"], r["value"]) for r in lattice.answer(levels[:1], requests).collect())
    assert [(a[0], a[1], a[2] if a[2] is None else pytest.approx(a[2])) for a in want] == got
    plain = {(y, a) for y, a in ((r["year"], r["area"]) for r in base.collect())}
    assert sum(g[0] == "rows ('area', 'year') 0" for g in got) == len(plain)
    assert not any(g[0].endswith(" 4") for g in got)


# ------------------------------------------------------------------ intervals


def test_blocks_of_an_interval_are_disjoint_and_exact(spark):
    rows = [(a, b) for a in range(-9, 9) for b in range(-10, 9)] + [(None, 3), (-2, None), (None, None), (5, 4), (-8, 7), (-100, 100)]
    frame = spark.createDataFrame(rows, "a int, b int").select("a", "b", intervals.blocks_of_interval(F.col("a"), F.col("b"), -8, 4).alias("blocks"))
    points = {r["x"]: {tuple(p) for p in r["p"]} for r in spark.range(-8, 8).select(F.col("id").alias("x"), intervals.blocks_of_point(F.col("id"), -8, 4).alias("p")).collect()}
    for r in frame.collect():
        own = [tuple(p) for p in r["blocks"]]
        assert len(own) == len(set(own)) and len(own) <= 8
        for x, around in points.items():
            inside = (r["a"] is None or r["a"] <= x) and (r["b"] is None or x <= r["b"])
            assert sum(p in around for p in own) == int(inside), (r["a"], r["b"], x)


def test_overlaps_equal_the_theta_join(spark):
    r = random.Random(2)
    end = lambda: r.choice([None, r.randint(-50, 50), r.randint(-5, 5)])
    left = [(k, r.choice([1, 2, None]), end(), end()) for k in range(150)] + [(900, 1, 0, 10**9), (901, 1, -(10**9), 10**9)]
    right = [(k, r.choice([1, 2, None]), end(), end()) for k in range(150)] + [(900, 1, 7, 7)] * 40
    x = spark.createDataFrame(left, "i int, g int, a int, b int")
    y = spark.createDataFrame(right, "j int, g int, c int, d int")
    low, high = (lambda v: -(10**12) if v is None else v), (lambda v: 10**12 if v is None else v)
    meet = lambda p, q: low(p[2]) <= high(q[3]) and low(q[2]) <= high(p[3]) and low(p[2]) <= high(p[3]) and low(q[2]) <= high(q[3])
    got = sorted((o["i"], o["j"]) for o in intervals.overlaps(x, y, ("a", "b"), ("c", "d"), ["g"]).collect())
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] is not None and p[1] == q[1] and meet(p, q))
    free = intervals.overlaps(x.drop("g"), y.drop("g"), ("a", "b"), ("c", "d"))
    assert sorted((o["i"], o["j"]) for o in free.collect()) == sorted((p[0], q[0]) for p in left for q in right if meet(p, q))
    assert "NestedLoop" not in free._jdf.queryExecution().executedPlan().toString()
    assert intervals.overlaps(x.limit(0), y, ("a", "b"), ("c", "d"), ["g"]).count() == 0
    with pytest.raises(ValueError):
        intervals.overlaps(x, x, ("a", "b"), ("a", "b"))


# ------------------------------------------------------------------ phrases


def test_longest_phrases_at_each_place(spark):
    r = random.Random(3)
    words = ["oil", "gas", "field", "été", "2p", "low", "of"]
    dictionary = [(" ".join(r.choices(words, k=r.randint(1, 3))), f"c{k % 3}", float(k)) for k in range(12)] + [("  ", "none", 1.0), (None, "none", 1.0), ("GAS, field!", "c9", 2.0)]
    texts = [(k, " ".join(r.choice([w, w.upper(), w + ",", "oilfield", "\n" + w]) for w in r.choices(words, k=r.randint(0, 25)))) for k in range(80)] + [(90, None), (91, ""), (92, "..."), (5, "gas field")]
    plain = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    known = {}
    for p, c, w in dictionary:
        if p and plain(p):
            known.setdefault(tuple(plain(p)), set()).add((p, c, w))
    want = []
    for k, t in texts:
        w, at = plain(t or ""), 0
        while at < len(w):
            n = next((n for n in (3, 2, 1) if tuple(w[at : at + n]) in known and at + n <= len(w)), 0)
            want += [(k, at + 1, *x) for x in known.get(tuple(w[at : at + n]), ())] if n else []
            at += max(n, 1)
    d = spark.createDataFrame(dictionary, "phrase string, concept string, weight double")
    t = spark.createDataFrame(texts, "k int, t string")
    assert sorted(tuple(x) for x in phrases.find(t, "k", "t", d).collect()) == sorted(want)
    top = {x["k"]: x["concept"] for x in phrases.best(t, "k", "t", d).collect()}
    assert set(top) == {x[0] for x in want}
    assert phrases.find(t, "k", "t", d.limit(0)).count() == 0 and phrases.find(t.limit(0), "k", "t", d).count() == 0


# ------------------------------------------------------------------ rejected input


def test_rejected_cells_and_rows_of_csv(spark, tmp_path):
    (tmp_path / "project_resources.csv").write_text('project_id;report_year;res_oc;extra\nA;2024;1.5;x\nB;year;2,5;x\nC;2023;3.5\nD;2023;4.5;x;too;many\nE;;;\n"F;f";2024;"7";"a\nb"\n')
    (tmp_path / "project_timeseries.csv").write_text("project_id;report_year;year\nA;2024;2030\n")
    got = files.load(spark, str(tmp_path), str(tmp_path / "out"))
    rows = {r["project_id"]: (r["report_year"], r["res_oc"]) for r in got["project_resources"].collect()}
    assert rows == {"A": (2024, 1.5), "B": (None, None), "C": (2023, 3.5), "D": (2023, 4.5), "E": (None, None), "F;f": (2024, 7.0)}
    assert got.counts["project_resources"] == {"rows": 6, "bad_cells": 2, "broken_rows": 2}
    assert got.counts["project_timeseries"] == {"rows": 1, "bad_cells": 0, "broken_rows": 0}
    found = sorted((r["table_name"], r["column"] or "", r["value"], r["reason"]) for r in got.rejects.collect())
    assert found == [("project_resources", "", "C;2023;3.5", "broken row"), ("project_resources", "", "D;2023;4.5;x;too;many", "broken row"), ("project_resources", "report_year", "year", "not int"), ("project_resources", "res_oc", "2,5", "not float")]
    assert all(json.loads(r["row"])["project_id"] in "BCD" and r["file"].endswith("project_resources.csv") for r in got.rejects.collect())


def test_rejected_cells_of_json(spark, tmp_path):
    (tmp_path / "project_resources.json").write_text('[{"project_id": "A", "report_year": 2024, "res_oc": "x"}, {"project_id": 5, "report_year": "2023.5", "res_oc": 2}, {"unknown": 1}]')
    raw = files.raw_table(spark, str(tmp_path), "project_resources", "json", snapshot_schema())
    found = sorted((r["column"], r["value"], r["reason"]) for r in files.rejects(raw, snapshot_schema(), "t").collect())
    assert ("res_oc", "x", "not float") in found and all(c in ("res_oc", "report_year") for c, _, _ in found)
    with pytest.raises(ValueError):
        files.raw_table(spark, str(tmp_path), "project_resources", "xml", snapshot_schema())


# ------------------------------------------------------------------ upserts of a stream

SCHEMA = "k int, year int, v string, ts timestamp"


def drop(spark, folder, name, rows):
    spark.createDataFrame(rows, "k int, year int, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").json(str(folder))
    return name


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).json(str(folder))


def state(spark, path):
    return sorted((r["k"], r["year"], r["v"]) for r in spark.read.parquet(path).collect())


def test_stream_replaces_touched_partitions(spark, tmp_path):
    source, path, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    start = lambda: upserts.upsert_stream(stream(spark, source), path, ["k", "year"], "ts", "1 hour", "year", check).awaitTermination()
    drop(spark, source, 1, [(1, 2020, "a", "2024-01-01 10:00:00"), (2, 2021, "b", "2024-01-01 10:00:00"), (1, 2020, "a", "2024-01-01 10:00:00")])
    start()
    assert state(spark, path) == [(1, 2020, "a"), (2, 2021, "b")]
    files_before = {p for p in (tmp_path / "table").rglob("*.parquet") if "year=2021" in str(p)}
    # a later row, and one that is older than what is there but within the watermark
    drop(spark, source, 2, [(1, 2020, "newer", "2024-01-01 10:30:00"), (3, 2020, "c", "2024-01-01 10:10:00"), (1, 2020, "older", "2024-01-01 09:50:00")])
    start()
    assert state(spark, path) == [(1, 2020, "newer"), (2, 2021, "b"), (3, 2020, "c")]
    assert files_before == {p for p in (tmp_path / "table").rglob("*.parquet") if "year=2021" in str(p)}
    # nothing new: nothing changes; a row far behind the watermark is not applied
    drop(spark, source, 3, [(9, 2020, "x", "2024-01-02 00:00:00")])
    start()
    drop(spark, source, 4, [(8, 2020, "too late", "2024-01-01 01:00:00")])
    start()
    assert state(spark, path) == [(1, 2020, "newer"), (2, 2021, "b"), (3, 2020, "c"), (9, 2020, "x")]


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(1, 2020, "a", "2024-01-01 10:00:00"), (1, 2020, "b", "2024-01-01 10:00:00"), (2, None, "n", "2024-01-01 10:00:00"), (None, 2020, "z", "2024-01-01 10:00:00")]
    batch = spark.createDataFrame(rows, "k int, year int, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    older = batch.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY")).withColumn("v", F.lit("old"))
    for b in (batch, batch, older, batch.limit(0), batch.orderBy(F.col("v").desc())):
        upserts.merge_batch(b, path, ["k", "year"], "ts", "year")
        now = sorted(((r["k"] or -1, r["year"] or -1, r["v"]) for r in spark.read.parquet(path).collect()))
        assert len(now) == 3 and "old" not in {v for _, _, v in now}
        first = now if b is batch else first
        assert now == first
    with pytest.raises(ValueError):
        upserts.merge_batch(batch, path, ["k"], "ts", "year")
