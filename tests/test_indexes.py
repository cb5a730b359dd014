"""Written indexes and maintained rollups against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.operators import maintained, rollup, substrings, vectors


def brute(rows, queries, k):
    def unit(v):
        v = np.asarray(v, float)
        return v / np.linalg.norm(v)

    good = [(i, unit(v)) for i, v in rows]
    out = {}
    for q, v in queries:
        order = sorted(((-round(float(unit(v) @ x), 12), i) for i, x in good))[:k]
        out[q] = [i for _, i in order]
    return out


def clustered(r, n, d=24, centres=60):
    c = r.normal(size=(centres, d))
    return c[r.integers(0, centres, n)] + 0.35 * r.normal(size=(n, d))


@pytest.fixture(scope="module")
def vector_table(spark):
    r = np.random.default_rng(1)
    x = clustered(r, 6000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    return rows, frame, vectors.build(frame, "id", "v")


def test_all_lists_give_the_exact_top(vector_table):
    rows, frame, index = vector_table
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    got = vectors.top_k(index, frame.where("id % 100 = 0"), "id", "v", 10).collect()
    want = brute(rows, asked, 10)
    for q in want:
        assert [g["key"] for g in sorted((g for g in got if g["query"] == q), key=lambda g: g["rank"])] == want[q]


def test_few_lists_reach_nine_tenths(vector_table):
    rows, frame, index = vector_table
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    got = vectors.top_k(index, frame.where("id % 100 = 0"), "id", "v", 10, probes=10).collect()
    want = brute(rows, asked, 10)
    hits = sum(len(set(want[q]) & {g["key"] for g in got if g["query"] == q}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    # what is probed is far less than everything
    model = vectors.Model.load(bytes(index.model.first()["model"]))
    assert len(model.centroids) == 77


def test_written_index_is_read_again(spark, vector_table, tmp_path):
    _, frame, index = vector_table
    vectors.save(index, str(tmp_path / "index"))
    again = vectors.load(spark, str(tmp_path / "index"))
    one, two = (sorted(tuple(r) for r in vectors.top_k(i, frame.where("id IN (5, 7)"), "id", "v", 3).collect()) for i in (index, again))
    assert one == two and len(one) == 6


def test_bounds_hold_codes():
    x = clustered(np.random.default_rng(2), 3000, 20)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = vectors.fit(x[:1500], 30)
    own, code, rest, _ = model.encode(x)
    coded = model.centroids[own] + np.concatenate([b[code[:, m]] for m, b in enumerate(model.books)], axis=1)
    assert np.all(np.abs(x @ x[0] - coded @ x[0]) <= rest + 1e-9)


def test_copies_and_unsound_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist()) for i in range(200)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)]
    rows += [(2000, [1e300, 2e300, 3e300, 4e300, 5e300, 6.5e300]), (2001, None), (2002, [0.0] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [1.0, 2.0]), (1000, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    index = vectors.build(frame, "id", "v")
    asked = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b", None), ("c", [0.0] * 6), ("d", [1.0, 2.0]), ("e", rows[3][1])], "q string, v array<double>")
    got = vectors.top_k(index, asked, "q", "v", 5).collect()
    assert [g["key"] for g in sorted((g for g in got if g["query"] == "a"), key=lambda g: g["rank"])] == [1000, 1000, 1001, 1002, 1003]
    assert all(abs(g["similarity"]) < 1.0001 for g in got)
    assert {g["query"] for g in got} == {"a", "e"}
    assert [g["key"] for g in got if g["query"] == "e" and g["rank"] == 1] == [3]
    none = vectors.build(frame.where("id = 2001"), "id", "v")
    assert vectors.top_k(none, asked, "q", "v", 5).collect() == []
    assert vectors.top_k(index, asked.limit(0), "q", "v", 5).collect() == []


# ------------------------------------------------------------------ substrings

TEXTS = ["Hello World", "hell", "", None, "Ünïcode ÉTÉ été", "100%_sure\\x", "aaaaaaaa", "日本語テキスト", "a\nb\nc", "x" * 4000 + "Needle" + "y" * 4000]


@pytest.mark.parametrize("pattern", ["hello", "LLO W", "ll", "", "été", "%_s", "_", "\\x", "aaaa", "本語テ", "needle", "zzz", "\nb\n", "nowhere at all"])
def test_search_equals_ilike(spark, pattern):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    index = substrings.build(frame, "id", "t")
    got = sorted(r["id"] for r in substrings.search(index, frame, "id", "t", pattern).collect())
    assert got == [i for i, t in enumerate(TEXTS) if pattern == "" or t is not None and pattern.lower() in t.lower()]


def test_search_is_a_semi_join(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    index = substrings.build(frame, "id", "t")
    plan = substrings.search(index, frame, "id", "t", "hello")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert "LeftSemi" not in substrings.search(index, frame, "id", "t", "he")._jdf.queryExecution().optimizedPlan().toString()


def test_batch_equals_every_single_search(spark):
    frame = spark.createDataFrame([*enumerate(TEXTS), (0, "again: HELLO")], "id long, t string")
    asked = [(k, p) for k, p in enumerate(["hello", "ll", None, "", "ÉTÉ", "%_S", "aaaa", "zzz", "h", "hello", "needle"])]
    index = substrings.build(frame, "id", "t")
    got = sorted(tuple(r) for r in substrings.search_batch(index, frame, "id", "t", spark.createDataFrame(asked, "p long, pattern string"), "p", "pattern").collect())
    rows = [*enumerate(TEXTS), (0, "again: HELLO")]
    assert got == sorted((k, i) for k, p in asked for i, t in rows if p and t is not None and p.lower() in t.lower())
    assert substrings.search_batch(index, frame.limit(0), "id", "t", spark.createDataFrame(asked, "p long, pattern string"), "p", "pattern").count() == 0


def test_postings_by_blocks(spark):
    """A run has a row for each block of rows, not for each row; blocks, repeated keys and characters beyond 16 bits lose nothing."""
    texts = [(f"k{i % 50}", f"Common words everywhere {i} 😀 a😀b" if i % 3 else f"common wor ds {i}") for i in range(120)]
    frame = spark.createDataFrame(texts, "id string, t string").repartition(3).localCheckpoint()
    index = substrings.build(frame, "id", "t")
    assert index.postings.where(F.exists("keys", lambda k: k == "k1")).count() < index.frequencies.agg(F.sum("n")).first()[0] / 5
    assert index.postings.groupBy("gram", "block").count().where("count > 1").count() == 0 and index.postings.select("block").distinct().count() == 3
    asked = [(k, p) for k, p in enumerate(["Words every", "a😀b", "😀 A", "wor ds 1", "RE 7", "not there"])]
    got = sorted(tuple(r) for r in substrings.search_batch(index, frame, "id", "t", spark.createDataFrame(asked, "p long, pattern string"), "p", "pattern").collect())
    assert got == sorted((k, i) for k, p in asked for i, t in texts if p.lower() in t.lower())
    for _, p in asked:
        assert sorted(r["id"] for r in substrings.search(index, frame, "id", "t", p).collect()) == sorted(i for i, t in texts if p.lower() in t.lower())


# ------------------------------------------------------------------ maintained rollups

LEVELS = rollup.snapshot_levels(("rec_oc",))
SCHEMA = "report_year int, wk_id long, field_id long, project_id long, project_stage string, project_class string, uncert_level string, wk_name string, field_name string, is_discovered int, pod_name string, rec_oc double"


def row(year, wk, field, project, volume, name=None):
    return (year, wk, field, project, "Exploitation", "c", "2P", name if name is not None else f"W{wk}", f"F{field}", project % 2, "p" if project % 3 else "", volume)


def rows_of(df):
    return sorted((tuple(sorted((k, v if not isinstance(v, float) else round(v, 6)) for k, v in r.asDict().items())) for r in df.collect()), key=str)


def equal_to_rebuild(spark, path):
    for k, want in enumerate(rollup.stack(maintained.read(spark, path), LEVELS)):
        assert rows_of(maintained.read(spark, path, k)) == rows_of(want)


def test_changes_equal_a_full_rebuild(spark, tmp_path):
    path = str(tmp_path / "r")
    base = [row(y, w, 10 * w + f, 100 * w + 10 * f + p, float(p + y % 7)) for y in (2020, 2021, 2022) for w in (1, 2) for f in (1, 2) for p in (1, 2, 3)]
    maintained.load(spark.createDataFrame(base, SCHEMA), path, LEVELS)
    equal_to_rebuild(spark, path)
    keys = ["report_year", "project_id", "uncert_level"]
    # one project changes: one group of each level is computed again
    counts = maintained.apply(spark.createDataFrame([row(2021, 1, 11, 111, 99.0)], SCHEMA), path, LEVELS, keys, ["field_id"])
    assert counts == [1, 1, 1]
    equal_to_rebuild(spark, path)
    assert maintained.read(spark, path, 2, [2021]).count() == 1
    # a project moves to another field and work area: the groups it left follow too
    counts = maintained.apply(spark.createDataFrame([row(2021, 2, 21, 111, 5.0)], SCHEMA), path, LEVELS, keys, ["field_id"])
    assert counts == [2, 2, 1]
    equal_to_rebuild(spark, path)
    # the last project of a field moves away: its group goes
    maintained.apply(spark.createDataFrame([row(2022, 1, 12, p, 1.0, "") for p in (111, 112, 113)], SCHEMA), path, LEVELS, keys, ["field_id"])
    equal_to_rebuild(spark, path)
    # a new year, and null keys
    maintained.apply(spark.createDataFrame([row(2023, 3, 31, 311, None), (2023, None, None, 7, None, None, "2P", None, None, None, None, 4.0)], SCHEMA), path, LEVELS, keys, ["field_id"])
    equal_to_rebuild(spark, path)
    before = {k: rows_of(maintained.read(spark, path, k)) for k in range(3)}
    maintained.apply(spark.createDataFrame([row(2023, 3, 31, 311, None)], SCHEMA), path, LEVELS, keys, ["field_id"])
    assert before == {k: rows_of(maintained.read(spark, path, k)) for k in range(3)}
    # a year is replaced, another is left empty
    maintained.replace_years(spark.createDataFrame([row(2020, 9, 91, 911, 3.0)], SCHEMA), path, LEVELS, [2020, 2023])
    equal_to_rebuild(spark, path)
    assert {r["report_year"] for r in maintained.read(spark, path, 2).collect()} == {2020, 2021, 2022}
    assert maintained.apply(spark.createDataFrame([], SCHEMA), path, LEVELS, keys, ["field_id"]) == [0, 0, 0]


def test_only_touched_partitions_are_scanned_and_written(spark, tmp_path):
    path = str(tmp_path / "r")
    maintained.load(spark.createDataFrame([row(y, 1, 11, 111, 1.0) for y in range(2000, 2010)], SCHEMA), path, LEVELS)
    plan = maintained.read(spark, path, 0, [2003])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_year" in plan and "2003" in plan
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "r").rglob("*.parquet")}
    maintained.apply(spark.createDataFrame([row(2003, 1, 11, 111, 2.0)], SCHEMA), path, LEVELS, ["report_year", "project_id", "uncert_level"], ["field_id"])
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "r").rglob("*.parquet")}
    assert {p for p in files if "report_year=2003" not in str(p)} == {p for p in now if now[p] == files.get(p)}
    with pytest.raises(ValueError):
        maintained.apply(spark.createDataFrame([row(2003, 1, 11, 111, 2.0)], SCHEMA), path, LEVELS, ["project_id"], ["field_id"])


def test_levels_with_remarks_and_factors_are_kept_up_to_date(spark, tmp_path):
    """The whole snapshot schema: minima, counts, recovery factors and joined remarks."""
    from orebody.plans.catalogue import snapshots

    path = str(tmp_path / "r")
    levels, orders = rollup.resource_levels()[:2], ("project_name,project_id", "field_name,field_id")
    rows = snapshots(spark, "/root/testdata/sf0.001").where("report_year IN (1996, 1997)")
    rows = rows.withColumn("report_year", F.col("report_year").cast("int"))
    maintained.load(rows.where("report_year = 1996 OR project_id % 2 = 0"), path, levels, orders)
    maintained.apply(rows.where("report_year = 1997"), path, levels, ["report_year", "project_id", "uncert_level"], ["field_id"], orders)
    below = maintained.read(spark, path)
    for k, level in enumerate(levels):
        below = rollup.roll_up(below, level, orders[k])
        got, want = maintained.read(spark, path, k), below
        names = sorted(want.columns)
        plain = lambda df: sorted((tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*names).collect()))
        assert plain(got) == plain(want)


def test_many_groups_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Beyond BROADCAST_GROUPS touched groups meet by a shuffle, however small their file; the levels are the same."""
    monkeypatch.setattr(maintained, "BROADCAST_GROUPS", 5)
    monkeypatch.setattr(maintained, "DEALT", 3, raising=False)
    rows = [row(2000 + y, k % 3, k, 100 * y + k, float(k), "" if k % 5 else None) for y in range(2) for k in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA)
    touched = maintained._groups(frame, LEVELS[0].keys, "touched")
    plan = frame.join(touched, maintained._same(frame, touched, LEVELS[0].keys), "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    path = str(tmp_path / "m")
    maintained.load(frame, path, LEVELS)
    maintained.apply(spark.createDataFrame([row(2001, k % 2, k, 100 + k, 2.0 * k) for k in range(15)], SCHEMA), path, LEVELS, ["report_year", "project_id", "uncert_level"], ["field_id"])
    for k, want in enumerate(rollup.stack(maintained.read(spark, path), LEVELS)):
        assert rows_of(maintained.read(spark, path, k)) == rows_of(want)
