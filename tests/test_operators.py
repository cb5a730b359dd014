"""Operators on small fixtures with known answers."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.functions import expressions as X
from orebody.functions import vocabulary as V
from orebody.operators import analysis, components, graph, ids, resolve, rollup, search, spatial, views
from orebody.operators.running import running
from orebody.plans import sqlgate
from orebody.sources import files, scratch
from orebody.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("payload,digit", [("2C0123", "B"), ("2C0124", "9"), ("AA9876", "4"), ("2C0123B012", "B"), ("xyz", None)])
def test_check_digit(spark, payload, digit):
    assert one(spark, X.check_digit(F.lit(payload))) == digit


@pytest.mark.parametrize("value,valid", [("F-2C-0123-B", True), ("F-2C-0123-C", False), ("nothing", False), (None, False)])
def test_field_id(spark, value, valid):
    assert one(spark, X.valid_field_id(F.lit(value).cast("string"))) is valid


@pytest.mark.parametrize(
    "text,codes",
    [
        ("Problem Cluster: 1.1.1. Subsurface Uncertainty", ["1.1.1"]),
        ("Kendala: 2.1 Marginal economics", ["2.1"]),
        ("Problem Cluster: 1.1.1. Subsurface dan Problem Cluster: 2.3 Portfolio", ["1.1.1", "2.3"]),
        ("masalah 1.1.1 dan 2.1", ["1.1.1", "2.1"]),
        ("2.3 then Kendala: 1.1.2", ["1.1.2", "2.3"]),
        ("9.9 and 7.7.7", []),
        ("", []),
        (None, []),
    ],
)
def test_problem_codes(spark, text, codes):
    assert one(spark, X.problem_codes(F.lit(text).cast("string"))) == codes


def test_volume_conversion(spark):
    assert round(one(spark, X.convert_volume(F.lit(1000.0), "MSTB", "BOPD", F.lit(2024))), 2) == 2732.24
    assert one(spark, X.convert_volume(F.lit(5.0), "MSTB", "XYZ", F.lit(2024))) == 5.0


def test_contains_text_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), (None,), ("A_B%",)], "t string")
    assert [r.t for r in df.where(X.contains_text(F.col("t"), "a_b")).collect()] == ["a_b", "A_B%"]
    assert df.where(X.contains_text(F.col("t"), "")).count() == 4


def test_remark_predicate(spark):
    df = spark.createDataFrame([("-",), (" N/A ",), (None,), ("real",), ("",)], "t string")
    assert [r.t for r in df.where(X.has_remark(F.col("t"))).collect()] == ["real"]


def test_uncertainty_names():
    assert V.uncertainty("2p").level == V.MIDDLE and V.uncertainty("2P").less is None
    assert (V.uncertainty("possible").level, V.uncertainty("possible").less) == (V.HIGH, V.MIDDLE)
    assert V.uncertainty("??").level == V.MIDDLE
    with pytest.raises(ValueError):
        analysis.level_sum("rec_oc", "probable")


def test_schema_sizes():
    assert {"rec_oil", "res_an", "uncert_level", "ghv_avg"} <= set(V.snapshot_schema().names)
    assert {"tpf_oc", "hist_year", "wk_lat"} <= set(V.series_schema().names)


def rollup_rows(spark):
    rows = [
        # year, wk_id, wk_name, field, stage, class, level, pod, remark, name, rec, res, disc
        (2024, "W1", "North", "F1", "Exploitation", "c", V.MIDDLE, "p", "one", "A", 10.0, 5.0, 1),
        (2024, "W1", "North", "F1", "Exploitation", "c", V.MIDDLE, "", "two", "B", None, 4.0, 1),
        (2024, "W2", "North", "F2", "Exploitation", "c", V.MIDDLE, None, None, "C", 7.0, 0.0, None),
        (2024, "W2", "North", "F2", "Exploitation", "c", V.MIDDLE, "q", "", "D", 3.0, 0.0, None),
        (2023, "W1", "North", "F1", "Exploitation", "c", V.LOW, "q", "only", "A", 1.0, 0.0, 1),
    ]
    return spark.createDataFrame(rows, "report_year int, wk_id string, wk_name string, field_id string, project_stage string, project_class string, uncert_level string, pod_name string, remark string, field_name string, rec_oc double, res_oc double, is_discovered int")


def test_three_level_rollup(spark):
    field, area, nation = rollup.stack(rollup_rows(spark), rollup.snapshot_levels(("rec_oc", "res_oc")))
    f = {(r.report_year, r.field_id): r for r in field.collect()}
    assert f[2024, "F1"].rec_oc == 10.0 and f[2024, "F1"].pod_count == 1 and f[2024, "F1"].project_count == 2
    assert f[2024, "F2"].is_discovered is None
    a = {r.report_year: r for r in area.collect()}
    assert a[2024].field_count == 2 and a[2024].project_count == 4 and a[2024].rec_oc == 20.0  # two ids share a name
    n = {r.report_year: r for r in nation.collect()}
    assert n[2024].wk_count == 1 and n[2024].field_count == 2


def test_joined_remarks(spark):
    level = rollup.Level(("field_id", "report_year"), remarks={"remarks": ("field_name", "remark")}, ratios={"rf": ("rec_oc", "res_oc")})
    found = {(r.field_id, r.report_year): r for r in rollup.roll_up(rollup_rows(spark), level).collect()}
    assert found["F1", 2024].remarks == "A: one\nB: two"
    assert found["F2", 2024].remarks == ""  # the first text is empty
    assert found["F1", 2023].remarks == "only"
    assert found["F2", 2024].rf == 0.0 and found["F1", 2024].rf == pytest.approx(10 / 9)


def test_filter_on_a_key_reaches_the_scan(spark, tmp_path):
    rollup_rows(spark).write.parquet(str(tmp_path / "t"))
    field = rollup.stack(spark.read.parquet(str(tmp_path / "t")), rollup.snapshot_levels(("rec_oc",))[:1])[0]
    plan = field.where("report_year = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(report_year,2024)" in plan


def test_latest_year_per_entity(spark):
    df = spark.createDataFrame([(1, 1996, 1.0), (1, 1999, 2.0), (2, 1997, 3.0), (2, 1998, 4.0)], "k int, report_year int, v double")
    assert sorted((r.k, r.report_year) for r in analysis.latest_year(df, 1998, ["k"]).collect()) == [(1, 1996), (2, 1998)]
    assert [(r.k, r.report_year) for r in analysis.latest_year(df, 1998).collect()] == [(2, 1998)]


def test_peak_takes_first_of_equal_years(spark):
    df = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, 5.0), (1, 2002, 1.0)], "k int, year int, v double")
    r = analysis.peak_year(df, ["k"], "v").first()
    assert (r.peak_year, r.peak_value) == (2000, 5.0)


def test_views(spark):
    df = spark.createDataFrame([(2024, "Alpha", 1.0, 2.0), (2023, "Beta", 3.0, 4.0)], "report_year int, project_name string, res_oc double, res_an double")
    out = views.apply_view(df, views.View(("reserves",), search="alp", search_column="project_name"))
    assert out.columns == ["report_year", "project_name", "reserves_mstb", "reserves_bscf"] and out.count() == 1
    with pytest.raises(ValueError):
        views.apply_view(df, views.View(("nothing",)))
    with pytest.raises(ValueError):
        views.apply_view(df, views.View(search="x", search_column="1=1"))


@pytest.mark.parametrize("text,ok", [("select 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("select 'drop; table'", True), ("drop table x", False), ("select 1; drop table x", False), ("insert into x select 1", False), ("WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", False)])
def test_read_only_gate(text, ok):
    assert sqlgate.reads_only(text) is ok


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "t.csv").write_text('project_id;project_name;report_year;rec_oil\n1;"field;with ""quotes""";2024;\n2;b;x;1.5\n')
    got = files.read_csv(spark, str(tmp_path / "t.csv"), V.snapshot_schema()).orderBy("project_id").collect()
    assert got[0].project_name == 'field;with "quotes"' and got[0].rec_oil is None and got[1].report_year is None and got[1].rec_oil == 1.5
    (tmp_path / "t.json").write_text(json.dumps([{"project_id": "1", "report_year": 2024}, {"report_year": 2023, "project_id": "2"}]))
    got = files.read_json(spark, str(tmp_path / "t.json"), V.snapshot_schema()).orderBy("project_id").collect()
    assert [(r.project_id, r.report_year) for r in got] == [("1", 2024), ("2", 2023)]
    derived = files.derive(files.read_json(spark, str(tmp_path / "t.json"), V.snapshot_schema()).withColumn("project_class", F.lit("3. Prospective Resources")).withColumn("project_stage", F.lit("1. x")))
    assert {(r.is_discovered, r.project_stage) for r in derived.collect()} == {(0, "Exploitation")}


def test_upsert_and_texts(spark):
    old = spark.createDataFrame([(1, 2024, "a"), (2, 2024, "b")], "id int, y int, t string")
    new = spark.createDataFrame([(2, 2024, "c"), (3, 2024, "d"), (3, 2024, "e")], "id int, y int, t string")
    assert sorted((r.id, r.t) for r in files.upsert(old, new, ["id", "y"], ["t"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.piped_text(old.orderBy("id"), 1).splitlines() == ["id | y | t", "1 | 2024 | a", "(first 1 rows)"]
    assert "1,234.50" in files.grid_text(spark.createDataFrame([(1234.5,)], "v double"))


def test_haversine_and_ellipsoid(spark):
    assert one(spark, X.haversine_km(F.lit(1.7167), F.lit(101.45), F.lit(1.8), F.lit(101.5))) == pytest.approx(10.8017, abs=1e-3)
    # a degree of latitude at the equator and a degree of longitude there, on WGS-84
    assert X.vincenty_km(np.array([0.0]), np.array([0.0]), np.array([1.0]), np.array([0.0]))[0] == pytest.approx(110.574, abs=2e-3)
    assert X.vincenty_km(np.array([0.0]), np.array([0.0]), np.array([0.0]), np.array([1.0]))[0] == pytest.approx(111.320, abs=2e-3)


def km(a, b):
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(min(1, h)))


def test_near_pairs_brute_force(spark):
    r = np.random.default_rng(3)
    lat = np.concatenate([r.uniform(-90, 90, 150), r.uniform(84, 90, 30), r.uniform(-3, 3, 40)])
    long = np.concatenate([r.uniform(-180, 180, 150), r.uniform(-180, 180, 30), np.where(r.random(40) < 0.5, r.uniform(176, 180, 40), r.uniform(-180, -176, 40))])
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, long))]
    df = spark.createDataFrame(pts, "id int, lat double, long double")
    for radius in (80.0, 700.0):
        found = [(x.a, x.b) for x in spatial.near_pairs(df, radius).collect()]
        want = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if km(a[1:], b[1:]) <= radius}
        assert len(found) == len(set(found)) and set(found) == want


def test_density_clusters_brute_force(spark):
    centres = {"D": (1.71, 101.45), "M": (1.61, 101.35), "J": (-6.20, 106.81)}
    pts = [(f"{k}{i}", a + d, b + d) for k, (a, b) in centres.items() for i, d in enumerate((0.0, 0.01, -0.01))]
    pts.append(("X0", 40.0, 10.0))
    got = spatial.clusters(spark.createDataFrame(pts, "id string, lat double, long double"), 5.0, 2).collect()
    assert len({r.cluster for r in got}) == 3 and all(r.size == 3 for r in got) and "X0" not in {r.id for r in got}
    r = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.normal(0, 1, 120), r.normal(0, 1, 120)))]
    least, radius = 4, 20.0
    near = {p[0]: {q[0] for q in pts if km(p[1:], q[1:]) <= radius} for p in pts}
    core = {p for p in near if len(near[p]) >= least}
    label = {p: p for p in core}
    for _ in core:
        label = {p: min(label[q] for q in near[p] & core) for p in core}
    for p in set(near) - core:
        if near[p] & core:
            label[p] = label[min(near[p] & core)]
    got = {x.id: x.cluster for x in spatial.clusters(spark.createDataFrame(pts, "id int, lat double, long double"), radius, least).collect()}
    assert set(got) == set(label)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(label)


def test_bm25_and_vectors(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "cafe cafe noir"), (3, "tea"), (4, None)], "id int, t string")
    got = search.bm25(docs, "id", "t", ["cafe"], 10).collect()
    assert [r.id for r in got] == [2, 1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "id int, v array<double>")
    assert [(r.id, r.similarity) for r in search.top_similar(v, "id", "v", [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.7071)]
    e = search.embed_column(docs, "t", "v", search.hashing_embedder(16))
    assert {len(r.v) for r in e.collect()} == {16}


def test_index_answers_like_the_texts(spark):
    docs = spark.createDataFrame([(1, "Café au lait, café"), (2, "cafe noir"), (3, "tea and lait"), (4, None), (5, "")], "id int, t string")
    index, sizes = search.postings(docs, "id", "t"), search.lengths(docs, "t")
    for query in (["café", "lait"], ["zzz"], ["TEA au"]):
        ask = lambda rows: [(r.id, round(r.score, 9)) for r in rows.collect()]
        assert ask(search.bm25(docs, "id", "t", query, 3)) == ask(search.bm25_of_index(index, sizes, "id", query, 3))


def test_clusters_have_centroids(spark):
    points = spark.createDataFrame([(1, 1.0, 101.0), (2, 1.01, 101.02), (3, 1.02, 101.01), (4, 50.0, 8.0)], "id int, lat double, long double")
    rows = spatial.centroids(points, spatial.clusters(points, 5.0, 2)).collect()
    assert [(r.cluster, r["size"], r.lat, r.long) for r in rows] == [(0, 3, 1.01, 101.01)]


def test_volume_columns():
    assert V.volume_columns("res") == ["res_oc", "res_an"] and V.volume_columns("rec", "gas", risked=True) == ["rec_ga_risked", "rec_gn_risked"]
    assert V.volume_columns("res", "oil", risked=True) == ["res_oil", "res_con"]


def test_a_view_is_ordered(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c"), (2, "a")], "report_year int, project_name string")
    out = views.apply_view(df, views.View(("all",), order=("report_year", "project_name"))).collect()
    assert [(r.report_year, r.project_name) for r in out] == [(1, "c"), (2, "a"), (2, "b"), (None, "a")]


def test_embedder_by_brute_force(spark):
    import zlib

    docs = [("alpha beta alpha",), ("",), (None,), ("Ω " * 3,)]
    got = [r.v for r in search.embed_column(spark.createDataFrame(docs, "t string"), "t", "v", search.hashing_embedder(16)).collect()]
    for (text,), vector in zip(docs, got):
        want = np.zeros(16)
        for word in (text or "").lower().split():
            code = zlib.crc32(word.encode())
            want[code % 16] += 1 if code >> 31 else -1
        assert np.allclose(vector, want / max(np.linalg.norm(want), 1e-9), atol=1e-6)


def test_graph_steps(spark):
    g = graph.Graph()
    g.add_nodes("a", spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string"), "k", "name")
    g.add_nodes("b", spark.createDataFrame([(10,)], "k int"), "k")
    g.add_edges("r", spark.createDataFrame([(1, 10), (1, 10), (2, None)], "s int, d int"), "s", "d")
    assert g.start("a", "a").step("r", "b", "b").rows.count() == 1
    assert g.start("a", "a").step("r", "b", "b", optional=True).rows.count() == 2
    assert g.start("b", "b").step("r", "a", "a", reverse=True).rows.first()["a_name"] == "x"


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in analysis.as_of_join(left, right, ["k"], "t", "t", "v").collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(path, tmp_path / "in" / "events.parquet")
    q = streams.stream_windows(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    stream = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.window_start, r.event_type): r.n for r in streams.windowed(events).collect()}
    assert stream and all(batch[k] == n for k, n in stream.items())


def test_forecast_flag_takes_either_year(spark):
    rows = spark.createDataFrame([(2025, 2025, 2024), (2025, 2024, 2026), (2025, None, 2024), (2024, 2024, None), (2023, 2024, 2024), (None, 2024, 2024)], "year int, hist int, report int")
    flag = X.is_forecast(F.col("year"), F.col("hist"), F.col("report"))
    assert [r.x for r in rows.select(flag.alias("x")).collect()] == [True, True, True, False, False, False]


def test_query_terms_lose_their_accents(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "cafe noir"), (3, "tea")], "id int, t string")
    assert {r.id for r in search.bm25(docs, "id", "t", ["Café"], 10).collect()} == {1, 2}
    assert search.bm25(docs, "id", "t", ["..."], 10).count() == 0


@pytest.mark.parametrize(
    "text,ok",
    [
        ("select java_method('java.lang.System', 'getProperty', 'user.home')", False),
        ("select `reflect`('java.lang.System', 'getProperty', 'user.home')", False),
        ("select 1 where exists (select try_reflect('java.lang.System', 'lineSeparator'))", False),
        ("select transform(a) using 'cat' from values (1) t(a)", False),
        ("with q as (select transform(a) using 'cat' from values (1) t(a)) select * from q", False),
        ("select * from parquet.`/etc`", False),
        ("select * from (select * from text.`/etc/passwd`)", False),
        ("select (select max(value) from csv.`/etc/passwd`)", False),
        ("select 'java_method(' as `update`, a.`drop` from values (1) a(`drop`)", True),
        ("select * from t where a in (select b from u)", True),
        ("select (1, 2) as pair, array(1), map('a', 1), struct(1 as update), replace('a', 'b', 'c')", True),
        ("select * from values (1, 'a') t(create, drop) where create in (1) order by drop limit 3", True),
        ("show tables", False),
        ("set x = 1", False),
        ("describe t", False),
        ("explain select 1", False),
        ("begin select 1; end", False),
        ("not sql", False),
    ],
)
def test_gate_lets_only_reading_queries_run(spark, text, ok):
    assert sqlgate.reads_only(text, spark) is ok
    if not ok:
        with pytest.raises(ValueError):
            sqlgate.run_sql(spark, text)


def test_gate_runs_with_arguments(spark):
    assert sqlgate.run_sql(spark, "select :a + 1 as x", {"a": 2}).first()["x"] == 3
    assert sqlgate.checked_name(spark, "range_of") if spark.catalog.tableExists("range_of") else True
    with pytest.raises(ValueError):
        sqlgate.checked_name(spark, "no such table")


def test_ids_go_on_where_existing_ones_end(spark):
    ask = lambda k, n, name: spark.createDataFrame([(k, n)], f"{name} string, total int")
    have = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    first = [r.field_id for r in ids.next_field_ids(ask("2C", 3, "grid"), have([], "field_id")).orderBy("field_id").collect()]
    assert first == ["F-2C-0123-B", "F-2C-0124-9", "F-2C-0125-7"]
    more = [r.field_id for r in ids.next_field_ids(ask("2c", 2, "grid"), have(["F-2C-0123-B", "f2c01249", "F-2C-0125-0", None], "field_id")).orderBy("field_id").collect()]
    assert more == ["F-2C-0125-7", "F-2C-0126-5"]
    got = [r.project_id for r in ids.next_project_ids(ask("F-2C-0123-B", 2, "field_id"), have(["P-2C0123B-01", "P-2C0123B-02", "P-2C0123B-03"], "project_id")).orderBy("project_id").collect()]
    assert got == ["P-2C0123B-04", "P-2C0123B-05"]
    got = [r.zone_id for r in ids.next_zone_ids(ask("F-2C-0123-B", 2, "field_id"), have(["Z-2C0123B-012-B", "Z-2C0123B-013-9"], "zone_id")).orderBy("zone_id").collect()]
    assert got == ["Z-2C0123B-014-7", "Z-2C0123B-015-5"]
    with pytest.raises(Exception, match="no suffix is left"):
        ids.next_project_ids(ask("F-2C-0123-B", 100, "field_id"), have([], "project_id")).collect()
    with pytest.raises(Exception, match="no field id"):
        ids.next_zone_ids(ask("F-2C-0123-C", 1, "field_id"), have([], "zone_id")).collect()


@pytest.mark.parametrize("value,valid", [("Z-2C0123B-012-B", True), ("z2c0123b012b", True), ("Z-2C0123B-012-C", False), ("Z-2C0123B-011-B", False), (None, False)])
def test_zone_id(spark, value, valid):
    assert one(spark, X.valid_zone_id(F.lit(value).cast("string"))) is valid


def named_points(spark):
    rows = [(1, "Duri", "Rokan", 1.0, 101.0), (2, "Duri North", "Rokan", 1.1, 101.0), (3, "Minas", "Rokan", 1.3, 101.0), (4, "Minas", "Other", -5.0, 110.0), (5, "Nowhere", "Other", None, None)]
    return spark.createDataFrame(rows, "id int, name string, wk_name string, lat double, long double")


def test_places_by_name(spark):
    p = named_points(spark)
    assert spatial.place_named(p, "duri").first()["id"] == 1 and spatial.place_named(p, "MIN").first()["id"] == 3
    assert spatial.place_named(p, "minas", "other").first()["id"] == 4
    status, rows = spatial.ask_places(p, "near_field", name="Duri", radius_km=20.0)
    assert status == "success" and [r.id for r in rows.collect()] == [2]
    assert spatial.ask_places(p, "near_field", name="Minas", area="Other", radius_km=20.0)[0] == "no_results"
    assert spatial.ask_places(p, "near_field", name="Atlantis")[0] == "not_found"
    assert spatial.ask_places(p, "distance", start="Duri", end="Atlantis")[0] == "not_found"
    assert spatial.ask_places(p, "distance", start="Duri", end="Minas")[1].first()["distance_km"] == pytest.approx(33.36, abs=0.01)
    assert [r.id for r in spatial.ask_places(p, "in_area", area="rokan")[1].collect()] == [1, 2, 3]
    assert spatial.ask_places(p, "coordinates", name="Nowhere")[0] == "not_found"
    assert spatial.ask_places(p, "nearest", lat=0.0, long=0.0, radius_km=1.0, limit=3)[0] == "no_results"
    assert spatial.ask_places(p, "adjacent_areas", area="Rokan", radius_km=2000.0)[1].first()["name"] == "Other"
    assert spatial.ask_places(p, "average_distance", names=["duri", "minas"])[1].first()["n_pairs"] == 3
    assert spatial.ask_places(p, "anything")[0] == "error" and spatial.ask_places(p, "near_field")[0] == "error"


def test_pair_statistics_refuse_many_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MAX_NAMED", 2)
    with pytest.raises(ValueError):
        spatial.pair_statistics(named_points(spark))


def test_running_numbers_and_sums(spark):
    df = spark.createDataFrame([(k * 7 % 50, k, float(k % 3)) for k in range(50)], "a int, b int, v double").repartition(5)
    rows = running(df, [F.col("a").desc(), F.col("b").asc()], ("v",)).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(50)) and [r.a for r in rows] == sorted((r.a for r in rows), reverse=True)
    assert [r.v_before for r in rows] == list(itertools.accumulate([0.0] + [r.v for r in rows]))[:-1]
    assert running(df.limit(0), [F.col("a").asc()]).count() == 0


def test_load_from_files(spark, tmp_path):
    (tmp_path / "project_resources.csv").write_text("project_id;report_year;uncert_level;project_class;project_stage;rec_oil\n1;2024;2. Middle Value;1. Reserves & GRR;2. Exploration;1.5\n2;2023;;4. Abandoned;;\n")
    (tmp_path / "project_timeseries.csv").write_text("project_id;report_year;year;wk_lat;tpf_oc\n1;2024;2030;9.5;2\n1;2024;2031;10.5;3\n")
    out = files.load(spark, str(tmp_path), str(tmp_path / "out"))
    snap = {r.project_id: r for r in out["project_resources"].collect()}
    assert (snap["1"].project_stage, snap["1"].is_discovered, snap["2"].is_discovered, snap["1"].report_year) == ("Exploration", 1, None, 2024)
    years = out["project_timeseries"].collect()
    assert len({r.uuid for r in years}) == 2 and {r.project_uuid for r in years} == {snap["1"].project_uuid} and min(r.wk_lat for r in years) == 9.5
    assert out["project_resources"].where("report_year = 2024").count() == 1
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path), "project_resources", "zip", V.snapshot_schema())
    assert files.source_url("https://host/", "project_timeseries", 2020).endswith("v2/project-timeseries?verbose=3&output=csv&report-year=2024")
    snap_frame = out["project_resources"]
    snap_frame.createOrReplaceTempView("loaded_snapshot")
    assert ("project_id", "string") in files.table_columns(spark, "loaded_snapshot")
    assert {r.table_name: r.n_rows for r in files.table_sizes(spark).collect()}["loaded_snapshot"] == 2


def test_all_levels_of_the_whole_schema(spark):
    snap = spark.createDataFrame([], V.snapshot_schema())
    field, area, nation = rollup.resources(snap)
    assert {"rf_gas", "urf_res_oil", "field_remarks", "groovy_count", "dcpy_uc_an", "ioip"} <= set(field.columns)
    assert {"wa_remarks", "unitisasi_count", "pod_count", "urf_rec_gas", "wk_id"} <= set(area.columns)
    assert {"wa_count", "pod_count", "field_count"} <= set(nation.columns) and "rf_oil" not in nation.columns
    assert [x.count() for x in rollup.forecasts(spark.createDataFrame([], V.series_schema()))] == [0, 0, 0]


@pytest.mark.parametrize("text,year", [("cadangan tahun 2023", 2023), ("tahun2021", 2021), ("data year 2019 ok", 2019), ("in 2020 and 2021", 2020), ("tahun 23", 2023), ("tahun 1999", None), ("kode 20233", None), ("nothing", None), (None, None)])
def test_asked_year(spark, text, year):
    assert one(spark, resolve.asked_year(F.lit(text).cast("string"))) == year


def test_entities_become_filters(spark):
    q = spark.createDataFrame([(1, "cadangan terbukti lapangan duri tahun 2024"), (2, "produksi Rokan"), (3, "duri dan minas"), (4, "apa saja"), (5, None)], "k int, t string")
    names = spark.createDataFrame([("Field", "Duri"), ("Field", "Minas"), ("WorkingArea", "Rokan"), ("Field", "Duri")], "kind string, name string")
    got = {r.k: (r.status, r.name, r.suggested_table, r.filter_column) for r in resolve.resolve_names(q, "k", "t", names).collect()}
    assert got[1] == ("success", "Duri", "field_resources", "field_name") and got[2] == ("success", "Rokan", "wa_timeseries", "wk_name")
    assert got[3][0] == "ambiguous" and got[4] == got[5] == ("failed", None, "project_resources", None)
    rows = rollup_rows(spark)
    assert rows.where(resolve.entity_filter(rows, {"year": 2023, "level": V.LOW, "field": None})).count() == 1
    with pytest.raises(ValueError):
        resolve.entity_filter(rows, {"operator": "x"})
    said = resolve.resolve(q, "k", "t").where("k = 1").first()
    assert (said.year, said.level, said["class"]) == (2024, V.LOW, "1. Reserves & GRR")


def test_contextual_filters(spark):
    rows = rollup_rows(spark)
    assert rows.where(search.contextual(rows, {"report_year": 2024, "wk_name": "nor", "field_name": "a"})).count() == 1
    with pytest.raises(ValueError):
        search.contextual(rows, {"1=1": "x"})
    with pytest.raises(ValueError):
        search.contextual(rows, {"province": "x"})


def test_embeddings_are_refreshed(spark):
    embed = search.hashing_embedder(8)
    old = search.refresh_embeddings(None, spark.createDataFrame([(1, "a", "alpha beta"), (1, "b", "gamma"), (2, "a", ""), (3, "a", None)], "id int, o string, t string"), ["id"], "t", ["o"], embed)
    assert [(r.id, r.o) for r in old.collect()] == [(1, "a")]
    new = search.refresh_embeddings(old, spark.createDataFrame([(1, "z", "delta"), (4, "z", "x")], "id int, o string, t string"), ["id"], "t", ["o"], embed)
    assert sorted((r.id, r.o) for r in new.collect()) == [(1, "z"), (4, "z")]
    # a long word counts with all of it
    a, b = (r.v for r in search.embed_column(spark.createDataFrame([("x" * 40 + "a",), ("x" * 40 + "b",)], "t string"), "t", "v", search.hashing_embedder(512)).collect())
    assert a != b


def test_code_search_scores(spark):
    asked = spark.createDataFrame([(1, "subsurface"), (2, "1.1.1"), (3, "zzz"), (4, None)], "k int, q string")
    got = {}
    for r in search.code_search(asked, "k", "q").collect():
        got.setdefault(r.k, []).append((r.code, r.score))
    assert got == {1: [("1.1.1", 50)], 2: [("1.1.1", 100)]}
    assert search.codes_in_category(spark, "economics").count() == 5


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch.root(Cluster())
    kept = scratch.settle(spark.range(3), "kept")
    assert kept.count() == 3 and scratch.clear_scratch(spark) and not scratch.clear_scratch(spark)


def test_as_of_join_of_one_key_over_many_ranges(spark):
    r = np.random.default_rng(2)
    left = [(1, int(t)) for t in r.integers(-50, 3000, 400)] + [(None, 5), (1, None)]
    right = [(1, int(t), f"v{k}") for k, t in enumerate(np.unique(r.integers(0, 2900, 150)))] + [(None, 2, "n"), (1, None, "x"), (1, 100, None)]
    got = sorted((str(x.k), str(x.t), str(x.v)) for x in analysis.as_of_join(spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, t int, v string"), ["k"], "t", "t", "v").collect())
    want = []
    for k, t in left:
        best = max((x for x in right if x[0] == k and x[1] is not None and t is not None and x[1] <= t and x[2] is not None), key=lambda x: x[1], default=None)
        want.append((str(k), str(t), str(best[2] if best else None)))
    assert got == sorted(want)


@pytest.mark.parametrize("small", [500_000, 3, 0])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    r = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(60)] + [(int(a), int(b)) for a, b in r.integers(100, 160, (30, 2))] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for a, b in edges if a is not None and a != b for n in (a, b)}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    words = spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")
    assert {x.component for x in components.components(words).collect()} == {"a"}
    assert components.components(words.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,table,want",
    [
        ("berapa cadangan lapangan duri?", "field_resources", ("cadangan", "res_oc", "res_an")),
        ("berapa cadangan minyak lapangan duri?", "field_resources", ("cadangan", "res_oil", "res_con")),
        ("berapa potensi lapangan duri?", "field_resources", ("potensi", "rec_oc", "rec_an")),
        ("berapa potensi eksplorasi lapangan duri?", "field_resources", ("prospective", "rec_oc_risked", "rec_an_risked")),
        ("potensi eksplorasi gas", "project_resources", ("prospective", "rec_ga", "rec_gn")),
        ("berapa potensi proyek X?", "project_resources", ("sumber_daya", "rec_oc", "rec_an")),
        (None, "project_resources", ("cadangan", "res_oc", "res_an")),
    ],
)
def test_asked_columns(spark, text, table, want):
    got = one(spark, resolve.asked_columns(F.lit(text).cast("string"), F.lit(table)))
    assert (got.volume, got.oil, got.gas) == want
