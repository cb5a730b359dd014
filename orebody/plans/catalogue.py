"""Every registered query of the resource engine with the SQL that checks it.

The star-schema tables stand for the domain: an order is a project, its customer a field,
the customer's nation a work area and all nations the country; priorities stand for
uncertainty levels and order years for report years.  Coordinates are a rule over keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import expressions as X
from orebody.functions import vocabulary as V
from orebody.functions.vocabulary import HIGH, LOW, MIDDLE, PROBLEMS
from orebody.operators import analysis, graph, ids, intervals, lattice, maintained, phrases, resolve, rollup, search, sketches, spatial, substrings, vectors, views
from orebody.operators.running import spread
from orebody.plans import sqlgate
from orebody.sources.scratch import scratch, settle
from orebody.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the domain's base tables

def projects(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """Snapshot rows: a project at an uncertainty level in a report year; a last year that is asked for reaches the scan as a date."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    if last is not None:
        o = o.where(F.col("o_orderdate") < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz"))
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), LOW).when(F.col("o_orderpriority").isin("2-HIGH", "4-NOT SPECIFIED"), MIDDLE).otherwise(HIGH)
    stage = F.when(F.col("o_orderstatus") == "F", "Exploitation").when(F.col("o_orderstatus") == "O", "Exploration").otherwise("Abandoned")
    # nations and regions are few by definition of the tables; customers are joined as AQE sees fit
    places = c.join(F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])), c["c_nationkey"] == n["n_nationkey"])
    joined = o.join(places, o["o_custkey"] == c["c_custkey"])
    return joined.select(
        F.year("o_orderdate").cast("int").alias("report_year"),
        F.col("n_nationkey").alias("wk_id"),
        F.col("n_name").alias("wk_name"),
        F.col("r_name").alias("region_name"),
        F.col("c_custkey").alias("field_id"),
        F.col("c_name").alias("field_name"),
        F.col("o_orderkey").alias("project_id"),
        stage.alias("project_stage"),
        F.col("c_mktsegment").alias("project_class"),
        level.alias("uncert_level"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("pod_name"),
        F.when(stage == "Abandoned", 0).otherwise(1).alias("is_discovered"),
        F.col("o_totalprice").alias("rec_oc"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("res_oc"),
    )


PROJECTS = f"""
projects AS (
  SELECT year(o_orderdate)::INT AS report_year, n_nationkey AS wk_id, n_name AS wk_name, r_name AS region_name, c_custkey AS field_id, c_name AS field_name,
         o_orderkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'Exploitation' WHEN 'O' THEN 'Exploration' ELSE 'Abandoned' END AS project_stage,
         c_mktsegment AS project_class,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN '{LOW}' WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN '{MIDDLE}' ELSE '{HIGH}' END AS uncert_level,
         NULLIF(o_orderstatus, 'P') AS pod_name, CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END AS is_discovered,
         o_totalprice AS rec_oc, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS res_oc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def series(spark: SparkSession, sf_dir: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """Yearly rows of a field (supplier) in a work area (nation); years that are asked for reach the scan as dates."""
    l, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    if years is not None:
        l = l.where(X.in_years(F.col("l_shipdate"), years))
    return l.join(s, l["l_suppkey"] == s["s_suppkey"]).select(
        F.lit(2001).alias("report_year"),
        F.col("s_nationkey").alias("wk_id"),
        F.col("s_suppkey").alias("field_id"),
        F.col("s_name").alias("field_name"),
        F.col("l_returnflag").alias("project_class"),
        F.col("l_linestatus").alias("project_level"),
        F.year("l_shipdate").cast("int").alias("year"),
        F.col("l_quantity").alias("tpf_oc"),
        F.col("l_extendedprice").alias("slf_oc"),
        F.col("l_discount").alias("ghv"),
    )


SERIES = """
series AS (
  SELECT 2001 AS report_year, s_nationkey AS wk_id, s_suppkey AS field_id, s_name AS field_name, l_returnflag AS project_class, l_linestatus AS project_level,
         year(l_shipdate)::INT AS year, l_quantity AS tpf_oc, l_extendedprice AS slf_oc, l_discount AS ghv
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# ---------------------------------------------------------------- rollups

SNAPSHOT = rollup.snapshot_levels(("rec_oc", "res_oc"))
FORECAST = rollup.series_levels(("tpf_oc", "slf_oc"))
FIELD_SQL = """
field AS (
  SELECT report_year, wk_id, field_id, project_stage, project_class, uncert_level, MIN(wk_name) AS wk_name, MIN(field_name) AS field_name, MAX(is_discovered) AS is_discovered,
         COUNT(NULLIF(pod_name, '')) AS pod_count, COUNT(*) AS project_count, SUM(rec_oc) AS rec_oc, SUM(res_oc) AS res_oc
  FROM projects GROUP BY ALL)"""
AREA_SQL = """
area AS (
  SELECT report_year, wk_name, project_stage, project_class, uncert_level, MAX(is_discovered) AS is_discovered, COUNT(*) AS field_count,
         SUM(project_count)::BIGINT AS project_count, SUM(rec_oc) AS rec_oc, SUM(res_oc) AS res_oc
  FROM field GROUP BY ALL)"""


@query("rollup_field", f"WITH {PROJECTS}, {FIELD_SQL} SELECT * REPLACE (ROUND(rec_oc, 2) AS rec_oc, ROUND(res_oc, 2) AS res_oc) FROM field")
def rollup_field(spark, sf_dir):
    return rounded(rollup.stack(projects(spark, sf_dir), SNAPSHOT[:1])[-1], rec_oc=2, res_oc=2)


@query("rollup_work_area", f"WITH {PROJECTS}, {FIELD_SQL}, {AREA_SQL} SELECT * REPLACE (ROUND(rec_oc, 2) AS rec_oc, ROUND(res_oc, 2) AS res_oc) FROM area")
def rollup_work_area(spark, sf_dir):
    return rounded(rollup.stack(projects(spark, sf_dir), SNAPSHOT[:2])[-1], rec_oc=2, res_oc=2)


@query(
    "rollup_national",
    f"""WITH {PROJECTS}, {FIELD_SQL}, {AREA_SQL}
SELECT report_year, project_stage, project_class, uncert_level, MAX(is_discovered) AS is_discovered, COUNT(*) AS wk_count, SUM(project_count)::BIGINT AS project_count,
       SUM(field_count)::BIGINT AS field_count, ROUND(SUM(rec_oc), 2) AS rec_oc, ROUND(SUM(res_oc), 2) AS res_oc
FROM area GROUP BY ALL""",
)
def rollup_national(spark, sf_dir):
    return rounded(rollup.stack(projects(spark, sf_dir), SNAPSHOT)[-1], rec_oc=2, res_oc=2)


def refreshed(spark, sf_dir, level: int) -> DataFrame:
    """A level after a load without 1997 and with wrong numbers of 1998, and one change that brings both."""
    p = projects(spark, sf_dir)
    path = scratch(spark, "maintained")
    stale = F.when(F.col("report_year") == 1998, F.col("rec_oc") * 2).otherwise(F.col("rec_oc"))
    maintained.load(p.where("report_year <> 1997").withColumn("rec_oc", stale), path, SNAPSHOT)
    maintained.apply(p.where("report_year IN (1997, 1998)"), path, SNAPSHOT, ["report_year", "project_id", "uncert_level"], ["field_id"])
    return rounded(maintained.read(spark, path, level), rec_oc=2, res_oc=2)


@query("refreshed_field", f"WITH {PROJECTS}, {FIELD_SQL} SELECT * REPLACE (ROUND(rec_oc, 2) AS rec_oc, ROUND(res_oc, 2) AS res_oc) FROM field")
def refreshed_field(spark, sf_dir):
    return refreshed(spark, sf_dir, 0)


@query("refreshed_national", ORACLES["rollup_national"])
def refreshed_national(spark, sf_dir):
    return refreshed(spark, sf_dir, 2)


_REQUESTS = [
    lattice.Request("total of the country by year", ("report_year",), "sum", "rec_oc"),
    lattice.Request("average of an area", ("wk_name", "report_year"), "avg", "rec_oc", (lattice.Filter("wk_name", "in", ("NATION_1", "NATION_2")),)),
    lattice.Request("greatest of classes at a level", ("project_class",), "max", "res_oc", (lattice.Filter("uncert_level", "=", (MIDDLE,)),)),
    lattice.Request("projects of some years", ("wk_name",), "rows", None, (lattice.Filter("report_year", "between", (1996, 1998)),)),
    lattice.Request("least of fields", ("field_id",), "min", "rec_oc", (lattice.Filter("report_year", "=", (1997,)),)),
    lattice.Request("volumes known of stages", ("project_stage",), "count", "res_oc"),
    lattice.Request("distinct fields by year", ("report_year",), "distinct", "field_id"),
    lattice.Request("average of all", (), "avg", "res_oc"),
    lattice.Request("average of classes without a name", ("project_class", "pod_name"), "avg", "rec_oc", (lattice.Filter("pod_name", "null"),)),
]
_LEVELS = {
    "field": (("report_year", "wk_name", "field_id", "uncert_level", "project_class"), ("rec_oc", "res_oc")),
    "area": (("report_year", "wk_name", "uncert_level", "project_class"), ("rec_oc", "res_oc")),
    "area_year": (("report_year", "wk_name"), ("rec_oc",)),
    "class": (("uncert_level", "project_class"), ("rec_oc", "res_oc")),
    "year": (("report_year",), ("rec_oc", "res_oc")),
}
#: Level that answers each request, as its keys, filters and measure ask.
_ANSWERED_BY = ["year", "area_year", "class", "area_year", "field", "base", "base", "year", "base"]


def _request_sql(r: lattice.Request, level: str) -> str:
    tests = {"=": "{c} = {0!r}", "in": "{c} IN {v}", "between": "{c} BETWEEN {0} AND {1}", "null": "{c} IS NULL"}
    where = " AND ".join(tests[f.test].format(*f.values, c=f.column, v=f.values) for f in r.filters) or "TRUE"
    value = {"rows": "COUNT(*)", "distinct": f"COUNT(DISTINCT {r.measure})"}.get(r.kind, f"{r.kind.upper()}({r.measure})")
    group = " || '|' || ".join(f"COALESCE({k}::VARCHAR, 'null')" for k in r.keys) or "''"
    return f"""SELECT '{r.name}' AS request, '{level}' AS level, {group} AS "group", ROUND(({value})::DOUBLE, 4) AS value FROM projects WHERE {where}""" + (f" GROUP BY {', '.join(r.keys)}" if r.keys else "")


@query("coarsest_level", f"WITH {PROJECTS} " + " UNION ALL ".join(_request_sql(r, v) for r, v in zip(_REQUESTS, _ANSWERED_BY)))
def coarsest_level(spark, sf_dir):
    return rounded(lattice.answer(lattice.build(settle(projects(spark, sf_dir), "projects"), _LEVELS), _REQUESTS), value=4)


_BUCKET = f"CASE WHEN rec_oc = 0 THEN 0 WHEN rec_oc > 0 THEN ceil(ln(abs(rec_oc)) / {sketches.log(sketches.GROWTH)!r}::DOUBLE)::INT + {1 << 20} ELSE -(ceil(ln(abs(rec_oc)) / {sketches.log(sketches.GROWTH)!r}::DOUBLE)::INT + {1 << 20}) END"
_MIDDLE = f"exp((b - {1 << 20}) * {sketches.log(sketches.GROWTH)!r}::DOUBLE) * {2 / (1 + sketches.GROWTH)!r}::DOUBLE"


@query(
    "quantiles_by_area",
    f"""WITH {PROJECTS}, v AS (SELECT wk_name, {_BUCKET} AS b, row_number() OVER (PARTITION BY wk_name ORDER BY {_BUCKET}) - 1 AS place, COUNT(*) OVER (PARTITION BY wk_name) AS n FROM projects WHERE rec_oc IS NOT NULL)
SELECT wk_name, ROUND(MAX(CASE WHEN place = floor(0.5::DOUBLE * (n - 1)) THEN {_MIDDLE} END), 4) AS median, ROUND(MAX(CASE WHEN place = floor(0.9::DOUBLE * (n - 1)) THEN {_MIDDLE} END), 4) AS q90 FROM v GROUP BY wk_name""",
)
def quantiles_by_area(spark, sf_dir):
    """Medians and ninth deciles of areas from the sketches of their fields, which are merged; the SQL is of the same buckets, in one pass."""
    levels = sketches.quantile_levels(projects(spark, sf_dir), "rec_oc", [("wk_name", "field_id"), ("wk_name",)])
    return rounded(sketches.quantile_estimates(levels[-1], {"median": 0.5, "q90": 0.9}), median=4, q90=4)


@query("distinct_by_area")
def distinct_by_area(spark, sf_dir):
    """Estimated numbers of projects of areas and of the country, merged from the sketches of fields; a test holds them to their bound."""
    levels = sketches.distinct_levels(projects(spark, sf_dir), "project_id", [("wk_name", "field_id"), ("wk_name",), ()])
    area, nation = (sketches.distinct_estimates(x) for x in levels[1:])
    return area.unionByName(nation.withColumn("wk_name", F.lit("all")))


CONTRACTS = "contracts AS (SELECT o_custkey, MIN(o_orderdate)::DATE AS eff_start, CASE WHEN o_custkey % 7 <> 0 THEN MAX(o_orderdate)::DATE END AS eff_end FROM orders GROUP BY o_custkey)"


def contracts(spark, sf_dir) -> DataFrame:
    """From a customer's first order to the last; every seventh is still open."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("eff_start"), F.max("o_orderdate").cast("date").alias("eff_end"))
    return o.withColumn("eff_end", F.when(F.col("o_custkey") % 7 != 0, F.col("eff_end")))


@query("interval_years", f"WITH {CONTRACTS} SELECT o_custkey, y::INT AS report_year FROM contracts, range(1990, 2005) t(y) WHERE eff_start <= make_date(y::INT, 12, 31) AND (eff_end IS NULL OR eff_end >= make_date(y::INT, 1, 1))")
def interval_years(spark, sf_dir):
    """The report years in which each contract is in effect."""
    c = contracts(spark, sf_dir).select("o_custkey", intervals.days(F.col("eff_start")).alias("a"), intervals.days(F.col("eff_end")).alias("b"))
    years = spark.range(1990, 2005).select(F.col("id").cast("int").alias("report_year"))
    years = years.select("report_year", intervals.days(F.make_date("report_year", F.lit(1), F.lit(1))).alias("c"), intervals.days(F.make_date("report_year", F.lit(12), F.lit(31))).alias("d"))
    return intervals.overlaps(c, years, ("a", "b"), ("c", "d")).select("o_custkey", "report_year")


@query("interval_overlaps", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 120)::INT AS b FROM orders) SELECT x.o_orderkey AS first_key, y.o_orderkey AS second_key FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND y.a <= x.b")
def interval_overlaps(spark, sf_dir):
    """Orders of one customer that are open at the same time."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", intervals.days(F.col("o_orderdate")).alias("a"))
    o = o.withColumn("b", (F.col("a") + F.col("o_orderkey") % 120).cast("int"))
    other = o.select("o_custkey", F.col("o_orderkey").alias("second_key"), F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = intervals.overlaps(o.withColumnRenamed("o_orderkey", "first_key"), other, ("a", "b"), ("c", "d"), ["o_custkey"])
    return pairs.where("first_key < second_key").select("first_key", "second_key")


SERIES_FIELD = """
sfield AS (
  SELECT report_year, wk_id, field_id, project_class, project_level, year, MIN(field_name) AS field_name, COUNT(*) AS project_count,
         SUM(tpf_oc) AS tpf_oc, SUM(slf_oc) AS slf_oc, AVG(ghv) AS ghv FROM series GROUP BY ALL)"""
SERIES_AREA = """
sarea AS (
  SELECT report_year, wk_id, project_class, project_level, year, COUNT(*) AS field_count, SUM(project_count)::BIGINT AS project_count,
         SUM(tpf_oc) AS tpf_oc, SUM(slf_oc) AS slf_oc, AVG(ghv) AS ghv FROM sfield GROUP BY ALL)"""
SERIES_ROUND = "SELECT * REPLACE (ROUND(tpf_oc, 2) AS tpf_oc, ROUND(slf_oc, 2) AS slf_oc, ROUND(ghv, 6) AS ghv)"


@query("rollup_series_field", f"WITH {SERIES}, {SERIES_FIELD} {SERIES_ROUND} FROM sfield")
def rollup_series_field(spark, sf_dir):
    return rounded(rollup.stack(series(spark, sf_dir), FORECAST[:1])[-1], tpf_oc=2, slf_oc=2, ghv=6)


@query("rollup_series_work_area", f"WITH {SERIES}, {SERIES_FIELD}, {SERIES_AREA} {SERIES_ROUND} FROM sarea")
def rollup_series_work_area(spark, sf_dir):
    return rounded(rollup.stack(series(spark, sf_dir), FORECAST[:2])[-1], tpf_oc=2, slf_oc=2, ghv=6)


@query(
    "rollup_series_national",
    f"""WITH {SERIES}, {SERIES_FIELD}, {SERIES_AREA}
SELECT report_year, project_class, project_level, year, COUNT(*) AS wk_count, SUM(project_count)::BIGINT AS project_count, SUM(field_count)::BIGINT AS field_count,
       ROUND(SUM(tpf_oc), 2) AS tpf_oc, ROUND(SUM(slf_oc), 2) AS slf_oc, ROUND(AVG(ghv), 6) AS ghv FROM sarea GROUP BY ALL""",
)
def rollup_series_national(spark, sf_dir):
    return rounded(rollup.stack(series(spark, sf_dir), FORECAST)[-1], tpf_oc=2, slf_oc=2, ghv=6)


@query(
    "flagship_total_by_region",
    f"""WITH {PROJECTS}, last AS (SELECT MAX(report_year) AS y FROM projects WHERE report_year <= 1998)
SELECT report_year, region_name, COUNT(*) AS project_count, ROUND(SUM(rec_oc), 2) AS rec_oc, ROUND(CASE WHEN SUM(rec_oc) > 0 THEN SUM(res_oc) / SUM(rec_oc) ELSE 0 END, 6) AS reserves_share
FROM projects WHERE uncert_level = '{MIDDLE}' AND report_year = (SELECT y FROM last) GROUP BY ALL""",
)
def flagship_total_by_region(spark, sf_dir):
    latest = analysis.latest_year(projects(spark, sf_dir, 1998), 1998).where(F.col("uncert_level") == MIDDLE)
    level = rollup.Level(("report_year", "region_name"), sums=("rec_oc",), rows="project_count", ratios={"reserves_share": ("res_oc", "rec_oc")})
    return rounded(rollup.roll_up(latest, level), rec_oc=2, reserves_share=6)


@query(
    "ratio_guarded",
    """SELECT p_brand, ROUND(CASE WHEN SUM(l_extendedprice) > 0 THEN SUM(l_extendedprice * l_discount) / SUM(l_extendedprice) ELSE 0 END, 6) AS factor
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def ratio_guarded(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    level = rollup.Level(("p_brand",), ratios={"factor": ("l_extendedprice * l_discount", "l_extendedprice")})
    return rounded(rollup.roll_up(l.join(p, l["l_partkey"] == p["p_partkey"]), level), factor=6)


@query("concat_remarks", "SELECT p_brand, p_size, CASE WHEN COUNT(*) > 1 THEN string_agg(p_name || ': ' || p_type, E'\\n' ORDER BY p_partkey) ELSE MIN(p_type) END AS remarks FROM part GROUP BY p_brand, p_size")
def concat_remarks(spark, sf_dir):
    level = rollup.Level(("p_brand", "p_size"), remarks={"remarks": ("p_name", "p_type")})
    return rollup.roll_up(read(spark, sf_dir, "part"), level, order="p_partkey")


@query("nonempty_count", "SELECT o_orderpriority, COUNT(NULLIF(NULLIF(o_orderstatus, 'P'), '')) AS n_named, COUNT(*) AS n_rows FROM orders GROUP BY o_orderpriority")
def nonempty_count(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("named", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return rollup.roll_up(o, rollup.Level(("o_orderpriority",), counts={"n_named": "named"}, rows="n_rows"))


# ---------------------------------------------------------------- levels and years

def _level_query(name: str, kind: str, expression: str):
    @query(name, f"WITH {PROJECTS} SELECT wk_name, ROUND({expression}, 2) AS volume FROM projects GROUP BY wk_name")
    def run(spark, sf_dir):
        return projects(spark, sf_dir).groupBy("wk_name").agg(F.round(analysis.level_sum("res_oc", kind), 2).alias("volume"))

    return run


def _at(level: str) -> str:
    return f"SUM(CASE WHEN uncert_level = '{level}' THEN res_oc END)"


_level_query("uncertainty_single", "2P", _at(MIDDLE))
_level_query("uncertainty_probable", "probable", f"{_at(MIDDLE)} - {_at(LOW)}")
_level_query("uncertainty_possible", "possible", f"{_at(HIGH)} - {_at(MIDDLE)}")


@query("year_fallback", f"WITH {PROJECTS} SELECT report_year, COUNT(*) AS n, ROUND(SUM(rec_oc), 2) AS rec_oc FROM projects WHERE report_year = (SELECT MAX(report_year) FROM projects WHERE report_year <= 1998) GROUP BY report_year")
def year_fallback(spark, sf_dir):
    return analysis.latest_year(projects(spark, sf_dir, 1998), 1998).groupBy("report_year").agg(F.count("*").alias("n"), F.round(F.sum("rec_oc"), 2).alias("rec_oc"))


@query(
    "year_fallback_entity",
    f"""WITH {PROJECTS}, last AS (SELECT field_id, MAX(report_year) AS report_year FROM projects WHERE report_year <= 1998 GROUP BY field_id)
SELECT field_id, report_year, ROUND(SUM(rec_oc), 2) AS rec_oc FROM projects JOIN last USING (field_id, report_year) GROUP BY field_id, report_year""",
)
def year_fallback_entity(spark, sf_dir):
    latest = analysis.latest_year(projects(spark, sf_dir, 1998), 1998, ["field_id"])
    return latest.groupBy("field_id", "report_year").agg(F.round(F.sum("rec_oc"), 2).alias("rec_oc"))


@query("entity_aggregate", f"WITH {PROJECTS}, own AS (SELECT * FROM projects WHERE wk_name LIKE '%A%' AND report_year <= 1997) SELECT ROUND({_at(MIDDLE)}, 2) AS res_oc FROM own WHERE report_year = (SELECT MAX(report_year) FROM own)")
def entity_aggregate(spark, sf_dir):
    return rounded(analysis.entity_total(projects(spark, sf_dir, 1997), "wk_name", "A", ["res_oc"], "2P", 1997), res_oc=2)


@query("year_pivot", f"WITH {PROJECTS} SELECT project_class, ROUND(SUM(CASE WHEN report_year = 1996 THEN rec_oc END), 2) AS y1996, ROUND(SUM(CASE WHEN report_year = 1997 THEN rec_oc END), 2) AS y1997 FROM projects WHERE report_year IN (1996, 1997) GROUP BY project_class")
def year_pivot(spark, sf_dir):
    return rounded(analysis.compare_years(projects(spark, sf_dir), ["project_class"], "rec_oc", (1996, 1997)), y1996=2, y1997=2)


YEARLY = f"WITH {SERIES}, yearly AS (SELECT field_id, year, SUM(tpf_oc) AS tpf_oc FROM series GROUP BY field_id, year)"


def yearly(spark, sf_dir) -> DataFrame:
    return series(spark, sf_dir).groupBy("field_id", "year").agg(F.sum("tpf_oc").alias("tpf_oc"))


@query("peak_year", f"{YEARLY} SELECT field_id, year AS peak_year, ROUND(tpf_oc, 2) AS peak_value FROM yearly QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY tpf_oc DESC, year) = 1")
def peak_year(spark, sf_dir):
    return rounded(analysis.peak_year(yearly(spark, sf_dir), ["field_id"], "tpf_oc"), peak_value=2)


@query("peak_year_ties", f"{YEARLY} SELECT field_id, year, ROUND(tpf_oc, 2) AS tpf_oc FROM yearly QUALIFY rank() OVER (PARTITION BY field_id ORDER BY tpf_oc DESC) = 1")
def peak_year_ties(spark, sf_dir):
    from pyspark.sql import Window

    place = F.rank().over(Window.partitionBy("field_id").orderBy(F.col("tpf_oc").desc()))
    return rounded(yearly(spark, sf_dir).withColumn("place", place).where("place = 1").drop("place"), tpf_oc=2)


@query("eol_year", f"WITH {SERIES} SELECT field_id, MAX(CASE WHEN tpf_oc > 45 OR slf_oc > 90000 THEN year END) AS eol_year FROM series GROUP BY field_id")
def eol_year(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"oil": F.col("tpf_oc") - 45, "gas": F.col("slf_oc") - 90000})
    return analysis.end_of_life(s, ["field_id"], "oil", "gas")


@query("onstream_year", f"WITH {SERIES} SELECT field_id, MIN(CASE WHEN tpf_oc > 45 OR slf_oc > 90000 THEN year END) AS onstream_year FROM series GROUP BY field_id")
def onstream_year(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"oil": F.col("tpf_oc") - 45, "gas": F.col("slf_oc") - 90000})
    return analysis.onstream(s, ["field_id"], "oil", "gas")


@query("onstream_known", f"WITH {SERIES} SELECT field_id, COALESCE(MIN(CASE WHEN wk_id % 2 = 0 THEN 1990 + field_id % 9 END), MIN(CASE WHEN tpf_oc > 45 OR slf_oc > 90000 THEN year END)) AS onstream_year FROM series GROUP BY field_id")
def onstream_known(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"oil": F.col("tpf_oc") - 45, "gas": F.col("slf_oc") - 90000, "known": F.when(F.col("wk_id") % 2 == 0, F.col("field_id") % 9 + 1990)})
    return analysis.onstream(s, ["field_id"], "oil", "gas", known="known")


@query("trend", f"WITH {SERIES} SELECT wk_id, year, ROUND(SUM(tpf_oc), 2) AS tpf_oc FROM series WHERE year BETWEEN 1996 AND 1999 GROUP BY wk_id, year")
def trend(spark, sf_dir):
    return rounded(analysis.trend(series(spark, sf_dir, (1996, 1997, 1998, 1999)), ["wk_id"], "tpf_oc", 1996, 1999), tpf_oc=2)


@query(
    "forecast_flag",
    f"""WITH {SERIES}, known AS (SELECT *, CASE wk_id % 4 WHEN 0 THEN NULL ELSE 1995 + wk_id % 4 END AS last_history, CASE field_id % 3 WHEN 0 THEN NULL ELSE 1996 + field_id % 3 END AS reported FROM series)
SELECT wk_id, year, CASE WHEN year > last_history THEN TRUE WHEN year > reported THEN TRUE ELSE FALSE END AS is_forecast, COUNT(*) AS n FROM known GROUP BY ALL""",
)
def forecast_flag(spark, sf_dir):
    wk, field = F.col("wk_id"), F.col("field_id")
    flag = X.is_forecast(F.col("year"), F.when(wk % 4 != 0, wk % 4 + 1995), F.when(field % 3 != 0, field % 3 + 1996))
    return series(spark, sf_dir).groupBy("wk_id", "year", flag.alias("is_forecast")).agg(F.count("*").alias("n"))


@query("unit_daily", f"WITH {SERIES} SELECT field_id, year, ROUND(SUM(tpf_oc) * 1000 / CASE WHEN year % 4 = 0 THEN 366 ELSE 365 END, 4) AS bopd FROM series GROUP BY field_id, year")
def unit_daily(spark, sf_dir):
    return yearly(spark, sf_dir).select("field_id", "year", F.round(X.convert_volume(F.col("tpf_oc"), "MSTB", "BOPD", F.col("year")), 4).alias("bopd"))


@query("barrels_equivalent", f"WITH {SERIES} SELECT wk_id, ROUND(SUM(tpf_oc) + SUM(slf_oc) / 5.615::DOUBLE * 1000, 0) AS mboe FROM series GROUP BY wk_id")
def barrels_equivalent(spark, sf_dir):
    s = series(spark, sf_dir).groupBy("wk_id").agg(F.sum("tpf_oc").alias("oil"), F.sum("slf_oc").alias("gas"))
    return s.select("wk_id", F.round(X.barrels_equivalent(F.col("oil"), F.col("gas")), 0).alias("mboe"))


@query("sales_potential", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice - l_extendedprice * (1 - l_discount), 4) AS potential FROM lineitem")
def sales_potential(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("sold", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(analysis.potential(l, "l_extendedprice", "sold").select("l_orderkey", "l_linenumber", "potential"), potential=4)


# the same rows under the name that an earlier round gave them
query("sales_potential_all", ORACLES["sales_potential"])(sales_potential)


# ---------------------------------------------------------------- rollups of the whole schema

def _factor(column: str) -> int:
    """A number from 1 to 9 for each measure, so that no two families add up alike."""
    return crc32(column.encode()) % 9 + 1


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows with every column that the rollups read; measures are multiples of the price, with gaps."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    places = c.join(F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])), c["c_nationkey"] == n["n_nationkey"])
    rows = o.join(places, o["o_custkey"] == c["c_custkey"])
    key = F.col("o_orderkey")
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), LOW).when(F.col("o_orderpriority").isin("2-HIGH", "4-NOT SPECIFIED"), MIDDLE).otherwise(HIGH)
    numbers = {"wk_id": "n_nationkey", "field_id": "c_custkey % 500", "project_id": "o_orderkey", "report_year": "int(year(o_orderdate))", "wk_lat": "n_nationkey - 12.5D", "wk_long": "n_nationkey * 4.25D", "wk_area_ori": "double(n_regionkey)", "wk_area_latest": "n_regionkey + 0.5D", "field_lat": "c_custkey % 80 + 0.25D", "field_long": "c_custkey % 170 + 0.5D", "field_area": "double(c_custkey % 7)"}
    flags = {"is_offshore": "int(c_custkey % 2)", "is_discovered": "int(if(o_orderkey % 3 = 0, null, o_orderkey % 2))", "is_unitization": "int(c_custkey % 3 = 0)", "project_isactive": "int(o_orderkey % 2)", "groovy_isactive": "int(o_orderkey % 3 = 1)", "fusion_isactive": "int(o_orderkey % 5 = 1)", "onstream_year": "int(1990 + o_orderkey % 20)"}
    texts = {"report_date": "concat('2024-0', 1 + o_orderkey % 9)", "report_status": "o_orderstatus", "wk_name": "n_name", "wk_subgroup": "r_name", "psc_eff_start": "concat('19', 70 + n_nationkey)", "psc_eff_end": "concat('20', 10 + n_nationkey)", "operator_group": "r_name", "operator_name": "c_mktsegment", "basin86_id": "concat('B', c_custkey % 86)", "basin86": "concat('Basin ', c_custkey % 86)", "basin128_id": "concat('C', c_custkey % 128)", "basin128": "concat('Area ', c_custkey % 128)", "prov_id": "concat('P', c_custkey % 30)", "province": "concat('Province ', c_custkey % 30)", "field_name": "concat('Field ', c_custkey % 500)", "project_name": "concat('Project ', o_orderkey % 50)", "onstream_actual": "concat('20', 10 + o_orderkey % 10)", "pod_name": "if(o_orderkey % 4 = 0, '', if(o_orderkey % 4 = 1, null, 'pod'))", "project_level": "o_orderpriority", "prod_stage": "o_orderstatus", "project_stage": "if(o_orderstatus = 'F', 'Exploitation', 'Exploration')", "project_class": "c_mktsegment", "project_remarks": "if(o_orderkey % 7 = 0, '', if(o_orderkey % 7 = 1, null, concat('remark ', o_orderkey)))", "vol_remarks": "if(o_orderkey % 5 = 0, null, concat('volume ', o_orderkey))"}
    measures = [F.when((key + _factor(m)) % 7 != 0, F.col("o_totalprice") * _factor(m)).alias(m) for m in V.SNAPSHOT_SUMS]
    return rows.select(*[F.expr(e).alias(name) for name, e in (numbers | flags | texts).items()], level.alias("uncert_level"), *measures)


# DuckDB's own spelling of the same rows
_SNAP_COLUMNS = """n_nationkey AS wk_id, c_custkey % 500 AS field_id, o_orderkey AS project_id, year(o_orderdate)::INT AS report_year, n_nationkey - 12.5::DOUBLE AS wk_lat, n_nationkey * 4.25::DOUBLE AS wk_long,
 n_regionkey::DOUBLE AS wk_area_ori, n_regionkey + 0.5::DOUBLE AS wk_area_latest, c_custkey % 80 + 0.25::DOUBLE AS field_lat, c_custkey % 170 + 0.5::DOUBLE AS field_long, (c_custkey % 7)::DOUBLE AS field_area,
 (c_custkey % 2)::INT AS is_offshore, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 2)::INT END AS is_discovered, (c_custkey % 3 = 0)::INT AS is_unitization, (o_orderkey % 2)::INT AS project_isactive,
 (o_orderkey % 3 = 1)::INT AS groovy_isactive, (o_orderkey % 5 = 1)::INT AS fusion_isactive, (1990 + o_orderkey % 20)::INT AS onstream_year,
 '2024-0' || (1 + o_orderkey % 9) AS report_date, o_orderstatus AS report_status, n_name AS wk_name, r_name AS wk_subgroup, '19' || (70 + n_nationkey) AS psc_eff_start, '20' || (10 + n_nationkey) AS psc_eff_end, r_name AS operator_group,
 c_mktsegment AS operator_name, 'B' || (c_custkey % 86) AS basin86_id, 'Basin ' || (c_custkey % 86) AS basin86, 'C' || (c_custkey % 128) AS basin128_id, 'Area ' || (c_custkey % 128) AS basin128, 'P' || (c_custkey % 30) AS prov_id,
 'Province ' || (c_custkey % 30) AS province, 'Field ' || (c_custkey % 500) AS field_name, 'Project ' || (o_orderkey % 50) AS project_name, '20' || (10 + o_orderkey % 10) AS onstream_actual,
 CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'pod' END AS pod_name, o_orderpriority AS project_level, o_orderstatus AS prod_stage, CASE o_orderstatus WHEN 'F' THEN 'Exploitation' ELSE 'Exploration' END AS project_stage, c_mktsegment AS project_class,
 CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'remark ' || o_orderkey END AS project_remarks, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE 'volume ' || o_orderkey END AS vol_remarks"""
_SUBSTANCES = ("oil", "con", "ga", "gn", "oc", "an")
_SNAP_MEASURES = [f"{p}_{x}{q}" for p, q in (("rec", ""), ("rec", "_risked"), ("res", ""), ("eur_rec", ""), ("eur_res", ""), ("rate_grs", ""), ("rate_sls", ""), ("cprd_grs", ""), ("cprd_sls", ""), ("dcpy_um", ""), ("dcpy_ppa", ""), ("dcpy_wi", ""), ("dcpy_cio", ""), ("dcpy_uc", "")) for x in _SUBSTANCES] + ["ghv_avg"]


def _measure_sql(names, price: str, key: str) -> str:
    return ", ".join(f"CASE WHEN ({key} + {_factor(m)}) % 7 <> 0 THEN {price} * {_factor(m)} END AS {m}" for m in names)


SNAPSHOTS = f"""snap AS (SELECT {_SNAP_COLUMNS}, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN '{LOW}' WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN '{MIDDLE}' ELSE '{HIGH}' END AS uncert_level,
 {_measure_sql([*_SNAP_MEASURES, "prj_ioip", "prj_igip"], "o_totalprice", "o_orderkey")}
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _remark_sql(label: str, text: str, order: str, between: str) -> str:
    first = f"first({text} ORDER BY {order}) FILTER (WHERE {text} IS NOT NULL)"
    return f"CASE WHEN COUNT(*) > 1 THEN CASE WHEN COALESCE({first}, '') = '' THEN '' ELSE string_agg({label} || ': ' || {text}, E'{between}' ORDER BY {order}) END ELSE {first} END"


def _factors_sql(oil: str, gas: str) -> str:
    ratio = "CASE WHEN SUM({d}) > 0 THEN SUM({n}) / SUM({d}) ELSE 0 END AS {name}"
    parts = [("rf_oil", "cprd_sls_oil", oil), ("rf_gas", "cprd_sls_gn", gas)]
    parts += [(f"urf_{k}_{s}", f"cprd_sls_{c} + {k}_{c}", d) for k in ("rec", "res") for s, c, d in (("oil", "oil", oil), ("gas", "gn", gas))]
    return ", ".join(ratio.format(name=name, n=n, d=d) for name, n, d in parts)


_AREA_MIN = "report_date report_status wk_lat wk_long wk_area_ori wk_area_latest wk_subgroup psc_eff_start psc_eff_end operator_group operator_name onstream_year onstream_actual project_level prod_stage".split()
_FIELD_MIN = "basin86_id basin86 basin128_id basin128 prov_id province field_name field_lat field_long field_area is_unitization".split()
_COUNTS = ("pod_count", "project_count", "project_active_count", "groovy_count", "fusion_count")
RESOURCE_SQL = f"""{SNAPSHOTS},
f AS (SELECT report_year, wk_id, field_id, project_stage, project_class, uncert_level, MIN(wk_name) AS wk_name, {', '.join(f'MIN({c}) AS {c}' for c in (*_AREA_MIN, *_FIELD_MIN))},
  MAX(is_offshore) AS is_offshore, MAX(is_discovered) AS is_discovered, COUNT(NULLIF(pod_name, '')) AS pod_count, COUNT(*) AS project_count, SUM(project_isactive)::BIGINT AS project_active_count, SUM(groovy_isactive)::BIGINT AS groovy_count,
  SUM(fusion_isactive)::BIGINT AS fusion_count, {_remark_sql('project_name', 'project_remarks', 'project_name, project_id', chr(92) + 'n')} AS field_remarks, {_remark_sql('project_name', 'vol_remarks', 'project_name, project_id', chr(92) + 'n')} AS field_vol_remarks,
  SUM(prj_ioip) AS ioip, SUM(prj_igip) AS igip, {_factors_sql('prj_ioip', 'prj_igip')}, {', '.join(f'SUM({m}) AS {m}' for m in _SNAP_MEASURES)}
  FROM snap GROUP BY report_year, wk_id, field_id, project_stage, project_class, uncert_level),
a AS (SELECT report_year, wk_name, project_stage, project_class, uncert_level, MIN(wk_id) AS wk_id, {', '.join(f'MIN({c}) AS {c}' for c in _AREA_MIN)}, MAX(is_offshore) AS is_offshore, MAX(is_discovered) AS is_discovered, COUNT(*) AS field_count,
  SUM(is_unitization)::BIGINT AS unitisasi_count, {', '.join(f'SUM({c})::BIGINT AS {c}' for c in _COUNTS)},
  {_remark_sql('field_name', 'field_remarks', 'field_name, field_id', chr(92) + 'n' + chr(92) + 'n')} AS wa_remarks, {_remark_sql('field_name', 'field_vol_remarks', 'field_name, field_id', chr(92) + 'n' + chr(92) + 'n')} AS wa_vol_remarks,
  SUM(ioip) AS ioip, SUM(igip) AS igip, {_factors_sql('ioip', 'igip')}, {', '.join(f'SUM({m}) AS {m}' for m in _SNAP_MEASURES)}
  FROM f GROUP BY report_year, wk_name, project_stage, project_class, uncert_level),
n AS (SELECT report_year, project_stage, project_class, uncert_level, MIN(report_status) AS report_status, COUNT(NULLIF(wk_id::VARCHAR, '')) AS wa_count, SUM(field_count)::BIGINT AS field_count, SUM(unitisasi_count)::BIGINT AS unitisasi_count,
  {', '.join(f'SUM({c})::BIGINT AS {c}' for c in _COUNTS)}, MAX(is_discovered) AS is_discovered, SUM(ioip) AS ioip, SUM(igip) AS igip, {', '.join(f'SUM({m}) AS {m}' for m in _SNAP_MEASURES)}
  FROM a GROUP BY report_year, project_stage, project_class, uncert_level)"""
_RATIOS = ("rf_oil", "rf_gas", "urf_rec_oil", "urf_rec_gas", "urf_res_oil", "urf_res_gas")


def _rounded_sql(measures, ratios=(), places: int = 6) -> str:
    return "* REPLACE (" + ", ".join([f"ROUND({m}, 2) AS {m}" for m in measures] + [f"ROUND({c}, {places}) AS {c}" for c in ratios]) + ")"


def _full(name: str, at: int, table: str, ratios: tuple[str, ...]) -> None:
    @query(name, f"WITH {RESOURCE_SQL} SELECT {_rounded_sql([*_SNAP_MEASURES, 'ioip', 'igip'], ratios)} FROM {table}")
    def run(spark, sf_dir):
        volumes = [c for c in V.SNAPSHOT_SUMS if not c.startswith("prj_")]
        rows = rollup.resources(snapshots(spark, sf_dir), at)[-1]
        return rounded(rows, **{c: 2 for c in (*volumes, "ioip", "igip")}, **{c: 6 for c in ratios})


_full("resources_field", 1, "f", _RATIOS)
_full("resources_work_area", 2, "a", _RATIOS)
_full("resources_national", 3, "n", ())


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series rows with every column that the rollups read."""
    l, s, n, r = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    places = s.join(F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])), s["s_nationkey"] == n["n_nationkey"])
    rows = l.join(places, l["l_suppkey"] == s["s_suppkey"])
    own = {"report_year": "2024", "wk_id": "s_nationkey", "field_id": "s_suppkey % 40", "project_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)", "year": "int(year(l_shipdate))", "project_class": "l_returnflag", "project_level": "l_linestatus", "is_offshore": "int(s_suppkey % 2)", "project_isactive": "int(l_orderkey % 2)", "onstream_year": "int(1990 + l_partkey % 20)", "ghv": "l_discount", "wk_lat": "n_nationkey - 12.5D", "wk_long": "n_nationkey * 4.25D", "wk_area": "double(n_regionkey)", "field_lat": "s_suppkey % 80 + 0.25D", "field_long": "s_suppkey % 170 + 0.5D"}
    own |= {"report_date": "concat('2024-0', 1 + l_partkey % 9)", "report_status": "l_linestatus", "wk_name": "n_name", "wk_subgroup": "r_name", "psc_eff_start": "concat('19', 70 + n_nationkey)", "psc_eff_end": "concat('20', 10 + n_nationkey)", "operator_group": "r_name", "operator_name": "concat('Operator ', s_suppkey % 9)", "prod_stage": "l_linestatus", "onstream_actual": "concat('20', 10 + l_partkey % 10)", "basin86_id": "concat('B', s_suppkey % 86)", "basin128": "concat('Area ', s_suppkey % 128)", "province": "concat('Province ', s_suppkey % 30)", "field_name": "concat('Field ', s_suppkey % 40)"}
    measures = [F.when((F.col("l_orderkey") + _factor(m)) % 7 != 0, F.col("l_extendedprice") * _factor(m)).alias(m) for m in dict.fromkeys(V.SERIES_SUMS)]
    return rows.select(*[F.expr(e).alias(c) for c, e in own.items()], *measures)


_SERIES_MEASURES = [f"{p}_{x}" for p in ("tpf", "tpf_risked", "slf", "spf", "crf", "prf", "ciof", "lossf", "cprd_grs", "cprd_sls", "rate") for x in _SUBSTANCES]
_SERIES_MIN = "report_date report_status wk_name wk_lat wk_long wk_area wk_subgroup psc_eff_start psc_eff_end operator_group operator_name prod_stage onstream_year onstream_actual".split()
FORECAST_SQL = f"""rows_ AS (SELECT 2024 AS report_year, s_nationkey AS wk_id, s_suppkey % 40 AS field_id, year(l_shipdate)::INT AS year, l_returnflag AS project_class, l_linestatus AS project_level, (s_suppkey % 2)::INT AS is_offshore,
  (l_orderkey % 2)::INT AS project_isactive, (1990 + l_partkey % 20)::INT AS onstream_year, l_discount AS ghv, n_nationkey - 12.5::DOUBLE AS wk_lat, n_nationkey * 4.25::DOUBLE AS wk_long, n_regionkey::DOUBLE AS wk_area, s_suppkey % 80 + 0.25::DOUBLE AS field_lat,
  s_suppkey % 170 + 0.5::DOUBLE AS field_long, '2024-0' || (1 + l_partkey % 9) AS report_date, l_linestatus AS report_status, n_name AS wk_name, r_name AS wk_subgroup, '19' || (70 + n_nationkey) AS psc_eff_start, '20' || (10 + n_nationkey) AS psc_eff_end,
  r_name AS operator_group, 'Operator ' || (s_suppkey % 9) AS operator_name, l_linestatus AS prod_stage, '20' || (10 + l_partkey % 10) AS onstream_actual, 'B' || (s_suppkey % 86) AS basin86_id, 'Area ' || (s_suppkey % 128) AS basin128,
  'Province ' || (s_suppkey % 30) AS province, 'Field ' || (s_suppkey % 40) AS field_name, {_measure_sql(_SERIES_MEASURES, "l_extendedprice", "l_orderkey")}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT report_year, wk_id, field_id, project_class, project_level, year, {', '.join(f'MIN({c}) AS {c}' for c in (*_SERIES_MIN, 'basin86_id', 'basin128', 'province', 'field_name', 'field_lat', 'field_long'))}, MAX(is_offshore) AS is_offshore, COUNT(*) AS project_count,
  SUM(project_isactive)::BIGINT AS active_project_count, AVG(ghv) AS ghv_avg, {', '.join(f'SUM({m}) AS {m}' for m in _SERIES_MEASURES)} FROM rows_ GROUP BY report_year, wk_id, field_id, project_class, project_level, year),
a AS (SELECT report_year, wk_id, project_class, project_level, year, {', '.join(f'MIN({c}) AS {c}' for c in _SERIES_MIN)}, MAX(is_offshore) AS is_offshore, COUNT(*) AS field_count, SUM(project_count)::BIGINT AS project_count,
  SUM(active_project_count)::BIGINT AS active_project_count, AVG(ghv_avg) AS ghv_avg, {', '.join(f'SUM({m}) AS {m}' for m in _SERIES_MEASURES)} FROM f GROUP BY report_year, wk_id, project_class, project_level, year),
n AS (SELECT report_year, project_class, project_level, year, MIN(report_status) AS report_status, MIN(prod_stage) AS prod_stage, COUNT(*) AS wa_count, SUM(field_count)::BIGINT AS field_count, SUM(project_count)::BIGINT AS project_count,
  SUM(active_project_count)::BIGINT AS active_project_count, AVG(ghv_avg) AS ghv_avg, {', '.join(f'SUM({m}) AS {m}' for m in _SERIES_MEASURES)} FROM a GROUP BY report_year, project_class, project_level, year)"""


def _full_series(name: str, at: int, table: str) -> None:
    @query(name, f"WITH {FORECAST_SQL} SELECT {_rounded_sql(_SERIES_MEASURES, ('ghv_avg',))} FROM {table}")
    def run(spark, sf_dir):
        return rounded(rollup.forecasts(forecast_rows(spark, sf_dir), at)[-1], **{c: 2 for c in dict.fromkeys(V.SERIES_SUMS)}, ghv_avg=6)


_full_series("forecasts_field", 1, "f")
_full_series("forecasts_work_area", 2, "a")
_full_series("forecasts_national", 3, "n")


# ---------------------------------------------------------------- views and filters

@query("detail_projection", f"WITH {PROJECTS} SELECT report_year, wk_name, field_name, project_stage, project_class, uncert_level, res_oc AS reserves_mstb FROM projects WHERE report_year IN (1996, 1998)")
def detail_projection(spark, sf_dir):
    return views.apply_view(projects(spark, sf_dir), views.View(("reserves",), years=(1996, 1998)))


@query("view_of_all", "SELECT * FROM customer WHERE c_mktsegment ILIKE '%build%'")
def view_of_all(spark, sf_dir):
    return views.apply_view(read(spark, sf_dir, "customer"), views.View(("all",), search="build", search_column="c_mktsegment"))


@query("ilike_filter", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%R#00000%1%' ESCAPE '\\'")
def ilike_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where(F.col("c_name").ilike("%R#00000%1%"))
    return views.apply_view(c, views.View(columns=("c_custkey", "c_name"), search="r#0000", search_column="c_name"))


@query("year_in", "SELECT o_orderkey, year(o_orderdate)::INT AS report_year FROM orders WHERE year(o_orderdate) IN (1997, 1999)")
def year_in(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where(X.in_years(F.col("o_orderdate"), (1997, 1999))).withColumn("report_year", F.year("o_orderdate").cast("int"))
    return views.apply_view(o, views.View(columns=("o_orderkey", "report_year"), years=(1997, 1999)))


@query("top_n", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 20")
def top_n(spark, sf_dir):
    return rounded(analysis.top(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", 20), o_totalprice=2)


@query("distinct_docs", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey || '-' || year(o_orderdate)) AS n FROM orders GROUP BY o_orderstatus")
def distinct_docs(spark, sf_dir):
    key = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"))
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct(key).alias("n"))


@query("anti_not_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_not_in(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_totalprice > 100000 AND o_custkey IS NOT NULL")
    return c.where("c_custkey IS NOT NULL").join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_in(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("left_join_missing", "SELECT COUNT(*) AS n_all, COUNT(o_custkey) AS n_with FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey")
def left_join_missing(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").agg(F.count("*").alias("n_all"), F.count("o_custkey").alias("n_with"))


@query("remark_filter", "SELECT lang, COUNT(*) AS n FROM documents WHERE text IS NOT NULL AND lower(trim(text)) NOT IN ('', '-', 'null', 'none', 'n/a', 'na') GROUP BY lang")
def remark_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(X.has_remark(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("not_null_text", "SELECT source, COUNT(*) AS n, MAX(length(text)) AS longest FROM documents WHERE text IS NOT NULL AND length(text) > 0 GROUP BY source")
def not_null_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL AND length(text) > 0")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    parts = [read(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


SQL_TEXT = """WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(total), 2) AS total FROM spend JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING COUNT(*) > 1"""


@query("sql_passthrough", SQL_TEXT.format(orders="orders", customer="customer"))
def sql_passthrough(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orebody_orders")
    read(spark, sf_dir, "customer").createOrReplaceTempView("orebody_customer")
    return sqlgate.run_sql(spark, SQL_TEXT.format(orders="orebody_orders", customer="orebody_customer"))


@query("sql_with_arguments", "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey")
def sql_with_arguments(spark, sf_dir):
    read(spark, sf_dir, "customer").createOrReplaceTempView("orebody_customer")
    text = "SELECT c_nationkey, COUNT(*) AS n FROM orebody_customer WHERE c_acctbal > :least AND c_mktsegment IN (:one, :two) GROUP BY c_nationkey"
    return sqlgate.run_sql(spark, text, {"least": 1000, "one": "BUILDING", "two": "MACHINERY"})


@query(
    "cube_totals",
    "SELECT o_orderstatus, o_orderpriority, GROUPING_ID(o_orderstatus, o_orderpriority)::BIGINT AS level, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
def cube_totals(spark, sf_dir):
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query(
    "as_of_join",
    """WITH v AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, MAX(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT v.event_id, p.paid FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts""",
)
def as_of_join(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    seen = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    paid = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("paid"))
    return analysis.as_of_join(seen, paid, ["user_id"], "ts", "ts", "paid").select("event_id", "paid")


# ---------------------------------------------------------------- places

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on the map: a rule over the key spreads them."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("wk_id"), (((k * 37) % 1700) / 10.0 - 85).cast("double").alias("lat"), (((k * 91) % 3600) / 10.0 - 180).cast("double").alias("long"))


PLACES = "places AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS wk_id, ((c_custkey * 37) % 1700) / 10.0::DOUBLE - 85 AS lat, ((c_custkey * 91) % 3600) / 10.0::DOUBLE - 180 AS long FROM customer)"


def _km(a: str, b: str) -> str:
    return f"{2 * X.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.long - {a}.long) / 2), 2))))"


@query("pairs_within_radius", f"WITH {PLACES} SELECT x.id AS a, y.id AS b, ROUND({_km('x', 'y')}, 4) AS km FROM places x JOIN places y ON x.id < y.id AND {_km('x', 'y')} <= 450")
def pairs_within_radius(spark, sf_dir):
    return spatial.near_pairs(places(spark, sf_dir), 450.0, digits=4)


@query("near_field", f"WITH {PLACES}, r AS (SELECT * FROM places WHERE id = 7) SELECT p.id, ROUND({_km('r', 'p')}, 4) AS km FROM r, places p WHERE p.id <> 7 AND {_km('r', 'p')} <= 1500 ORDER BY {_km('r', 'p')}, p.id LIMIT 10")
def near_field(spark, sf_dir):
    p = places(spark, sf_dir)
    r = p.where("id = 7").first()
    return rounded(spatial.within(p, r["lat"], r["long"], 1500.0, 10, exclude=7).select("id", "km"), km=4)


@query("nearest_from_point", f"WITH {PLACES}, r AS (SELECT 10.0 AS lat, 20.0 AS long) SELECT p.id, ROUND({_km('r', 'p')}, 4) AS km FROM r, places p WHERE {_km('r', 'p')} <= 1000 ORDER BY {_km('r', 'p')}, p.id LIMIT 15")
def nearest_from_point(spark, sf_dir):
    return rounded(spatial.within(places(spark, sf_dir), 10.0, 20.0, 1000.0, 15).select("id", "km"), km=4)


@query("nearest_each", f"WITH {PLACES}, d AS (SELECT x.id AS place, y.id, {_km('x', 'y')} AS km FROM places x JOIN places y ON x.id <> y.id) SELECT place, row_number() OVER (PARTITION BY place ORDER BY km, id)::INT AS rank, ROUND(km, 4) AS km FROM d QUALIFY rank <= 5")
def nearest_each(spark, sf_dir):
    """The distances of the five nearest others of every place; ids are left out, as equal distances differ in the last bit."""
    return rounded(spatial.nearest_each(places(spark, sf_dir), 5).select("place", "rank", "km"), km=4)


@query("nearest_on_ellipsoid")
def nearest_on_ellipsoid(spark, sf_dir):
    return rounded(spatial.within(places(spark, sf_dir), 10.0, 20.0, 1000.0, 15, "ellipsoid").select("id", "km"), km=2)


@query("fields_in_area", f"WITH {PLACES} SELECT DISTINCT id, name FROM places WHERE wk_id = 3")
def fields_in_area(spark, sf_dir):
    return places(spark, sf_dir).where("wk_id = 3").select("id", "name").distinct()


@query(
    "adjacent_areas",
    f"WITH {PLACES}, c AS (SELECT wk_id AS id, AVG(lat) AS lat, AVG(long) AS long FROM places GROUP BY wk_id) SELECT x.id AS ref_id, y.id, ROUND({_km('x', 'y')}, 4) AS km FROM c x JOIN c y ON x.id <> y.id AND {_km('x', 'y')} <= 1200",
)
def adjacent_areas(spark, sf_dir):
    centres = places(spark, sf_dir).groupBy(F.col("wk_id").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("long").alias("long"))
    return rounded(spatial.near_each(centres, centres, 1200.0), km=4)


@query("pair_stats", f"WITH {PLACES}, few AS (SELECT * FROM places WHERE id IN (3, 14, 15, 92, 65)), d AS (SELECT {_km('x', 'y')} AS km FROM few x JOIN few y ON x.id < y.id) SELECT ROUND(AVG(km), 4) AS avg_km, ROUND(MIN(km), 4) AS min_km, ROUND(MAX(km), 4) AS max_km, COUNT(*) AS n_pairs FROM d")
def pair_stats(spark, sf_dir):
    return rounded(spatial.pair_statistics(places(spark, sf_dir).where(F.col("id").isin(3, 14, 15, 92, 65))), avg_km=4, min_km=4, max_km=4)


DENSITY = f"""WITH RECURSIVE {PLACES}, pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM places x JOIN places y ON x.id <> y.id AND {_km('x', 'y')} <= 450),
core AS MATERIALIZED (SELECT a AS id FROM pairs GROUP BY a HAVING COUNT(*) + 1 >= 4),
inner_ AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS other FROM core UNION SELECT r.id, b FROM reach r JOIN inner_ ON a = r.other),
cored AS (SELECT id, MIN(other) AS component FROM reach GROUP BY id),
border AS (SELECT a AS id, min_by(component, b) AS component FROM pairs JOIN cored ON b = cored.id WHERE a NOT IN (SELECT id FROM core) GROUP BY a),
members AS (SELECT * FROM cored UNION ALL SELECT * FROM border),
sizes AS (SELECT component, COUNT(*) AS size, (row_number() OVER (ORDER BY COUNT(*) DESC, component) - 1)::INT AS cluster FROM members GROUP BY component)"""


@query("density_clusters", f"{DENSITY} SELECT id, cluster, size FROM members JOIN sizes USING (component)")
def density_clusters(spark, sf_dir):
    return spatial.clusters(places(spark, sf_dir), 450.0, 4)


@query("cluster_centroids", f"{DENSITY} SELECT cluster, COUNT(*) AS size, ROUND(AVG(lat), 4) AS lat, ROUND(AVG(long), 4) AS long FROM members JOIN sizes USING (component) JOIN places USING (id) GROUP BY cluster")
def cluster_centroids(spark, sf_dir):
    p = places(spark, sf_dir)
    return spatial.centroids(p, spatial.clusters(p, 450.0, 4)).orderBy("cluster")


def named_places(spark, sf_dir) -> DataFrame:
    """Customers with a work area's name beside the key of their nation."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("wk_id"), F.col("n_name").alias("wk_name"))
    return places(spark, sf_dir).join(F.broadcast(n), "wk_id").select("id", "name", "wk_name", "lat", "long")


NAMED = f"{PLACES}, named AS (SELECT id, name, n_name AS wk_name, lat, long FROM places JOIN nation ON wk_id = n_nationkey)"


def _one(name: str, text: str, area: str = "") -> str:
    inside = f" AND wk_name ILIKE '%{area}%'" if area else ""
    return f"{name} AS (SELECT * FROM named WHERE name ILIKE '%{text}%'{inside} ORDER BY lower(name) <> lower('{text}'), name, id LIMIT 1)"


@query("distance_of_names", f"WITH {NAMED}, {_one('x', '0000011')}, {_one('y', 'customer#000000023')} SELECT x.name AS from_name, y.name AS to_name, ROUND({_km('x', 'y')}, 2) AS distance_km FROM x, y")
def distance_of_names(spark, sf_dir):
    return spatial.ask_places(named_places(spark, sf_dir), "distance", start="0000011", end="customer#000000023")[1]


@query("coordinates_of_name", f"WITH {NAMED}, {_one('x', '00001', 'nation_1')} SELECT * FROM x")
def coordinates_of_name(spark, sf_dir):
    return spatial.ask_places(named_places(spark, sf_dir), "coordinates", name="00001", area="nation_1")[1]


@query("near_name_in_area", f"WITH {NAMED}, {_one('r', '00001', 'nation_1')} SELECT p.id, p.name, ROUND({_km('r', 'p')}, 4) AS km FROM r, named p WHERE p.wk_name ILIKE '%nation_1%' AND p.id <> r.id AND {_km('r', 'p')} <= 4000 ORDER BY {_km('r', 'p')}, p.id LIMIT 10")
def near_name_in_area(spark, sf_dir):
    near = spatial.near_named(named_places(spark, sf_dir), "00001", 4000.0, 10, "nation_1", "haversine")
    return rounded(near.select("id", "name", "km"), km=4)


@query("places_in_area", f"WITH {NAMED} SELECT DISTINCT id, name, wk_name, lat, long FROM named WHERE wk_name ILIKE '%nation_2%' ORDER BY name, id LIMIT 50")
def places_in_area(spark, sf_dir):
    return spatial.ask_places(named_places(spark, sf_dir), "in_area", area="nation_2")[1]


@query("ask_near_field", f"WITH {NAMED}, {_one('r', 'customer#000000023')} SELECT p.id, p.name, ROUND({_km('r', 'p')}, 4) AS km FROM r, named p WHERE p.id <> r.id AND {_km('r', 'p')} <= 2500 ORDER BY {_km('r', 'p')}, p.id LIMIT 12")
def ask_near_field(spark, sf_dir):
    rows = spatial.ask_places(named_places(spark, sf_dir), "near_field", name="customer#000000023", radius_km=2500.0, limit=12, kind="haversine")[1]
    return rounded(rows.select("id", "name", "km"), km=4)


@query("ask_nearest", f"WITH {NAMED}, r AS (SELECT -30.0 AS lat, 179.5 AS long) SELECT p.id, p.wk_name, ROUND({_km('r', 'p')}, 4) AS km FROM r, named p WHERE {_km('r', 'p')} <= 1800 ORDER BY {_km('r', 'p')}, p.id LIMIT 8")
def ask_nearest(spark, sf_dir):
    rows = spatial.ask_places(named_places(spark, sf_dir), "nearest", lat=-30.0, long=179.5, radius_km=1800.0, limit=8)[1]
    return rounded(rows.select("id", "wk_name", "km"), km=4)


@query("ask_clusters", f"{DENSITY} SELECT cluster, ANY_VALUE(size) AS size, MIN(id) AS least FROM members JOIN sizes USING (component) GROUP BY cluster")
def ask_clusters(spark, sf_dir):
    rows = spatial.ask_places(places(spark, sf_dir), "clusters", radius_km=450.0, least=4)[1]
    return rows.groupBy("cluster").agg(F.max("size").alias("size"), F.min("id").alias("least"))


@query("ask_adjacent_areas", f"WITH {NAMED}, c AS (SELECT wk_name AS name, AVG(lat) AS lat, AVG(long) AS long FROM named GROUP BY wk_name), r AS (SELECT * FROM c WHERE name ILIKE '%nation_3%' ORDER BY lower(name) <> 'nation_3', name LIMIT 1) SELECT p.name, ROUND({_km('r', 'p')}, 3) AS km FROM r, c p WHERE p.name <> r.name AND {_km('r', 'p')} <= 3000 ORDER BY {_km('r', 'p')}, p.name LIMIT 10")
def ask_adjacent_areas(spark, sf_dir):
    rows = spatial.ask_places(named_places(spark, sf_dir), "adjacent_areas", area="nation_3", radius_km=3000.0, kind="haversine")[1]
    return rounded(rows.select("name", "km"), km=3)


@query("ask_average_distance", f"WITH {NAMED}, few AS (SELECT * FROM named WHERE lower(name) IN ('customer#000000003', 'customer#000000014', 'customer#000000065', 'customer#000000092')), d AS (SELECT {_km('x', 'y')} AS km FROM few x JOIN few y ON x.id < y.id) SELECT ROUND(AVG(km), 4) AS avg_km, ROUND(MIN(km), 4) AS min_km, ROUND(MAX(km), 4) AS max_km, COUNT(*) AS n_pairs FROM d")
def ask_average_distance(spark, sf_dir):
    names = [f"Customer#0000000{n:02d}" for n in (3, 14, 65, 92)]
    return rounded(spatial.ask_places(named_places(spark, sf_dir), "average_distance", names=names)[1], avg_km=4, min_km=4, max_km=4)


# ---------------------------------------------------------------- texts, codes, vectors

TERMS = ["that", "ther", "avec"]
_TOKENS = f"list_filter(regexp_split_to_array(translate(lower(COALESCE(text, '')), '{search.ACCENTS[0]}', '{search.ACCENTS[1]}'), '[^a-z0-9]+'), lambda w: w <> '')"


@query(
    "bm25_topk",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))} FROM t),
s AS (SELECT COUNT(*) AS docs, AVG(n) AS mean, {', '.join(f"SUM((tf{i} > 0)::INT) AS df{i}" for i in range(len(TERMS)))} FROM c)
SELECT doc_id, ROUND({' + '.join(f"ln(1 + (docs - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * {search.K1 + 1}::DOUBLE / (tf{i} + {search.K1}::DOUBLE * ({1 - search.B}::DOUBLE + {search.B}::DOUBLE * n / mean))" for i in range(len(TERMS)))}, 6) AS score
FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))} ORDER BY score DESC, doc_id LIMIT 25""",
)
def bm25_topk(spark, sf_dir):
    return rounded(search.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", TERMS, 25), score=6)


@query(
    "bm25_of_index",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT COUNT(*) AS docs, AVG(len(w)) AS mean FROM t),
p AS (SELECT doc_id, term, COUNT(*) AS tf, ANY_VALUE(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN ('deja', 'the', 'avec') GROUP BY doc_id, term),
d AS (SELECT term, COUNT(*) AS df FROM p GROUP BY term)
SELECT doc_id, ROUND(SUM(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {search.K1 + 1}::DOUBLE / (tf + {search.K1}::DOUBLE * ({1 - search.B}::DOUBLE + {search.B}::DOUBLE * n / mean))), 6) AS score
FROM p JOIN d USING (term), s GROUP BY doc_id ORDER BY SUM(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {search.K1 + 1}::DOUBLE / (tf + {search.K1}::DOUBLE * ({1 - search.B}::DOUBLE + {search.B}::DOUBLE * n / mean))) DESC, doc_id LIMIT 25""",
)
def bm25_of_index(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return rounded(search.bm25_of_index(search.postings(d, "doc_id", "text"), search.lengths(d, "text"), "doc_id", ["Déjà the", "AVEC"], 25), score=6)


@query("postings", f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS term FROM t) SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS cf FROM p GROUP BY term")
def postings(spark, sf_dir):
    return search.postings(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("substring_search", "SELECT doc_id, source FROM documents WHERE text ILIKE '%license, VERSION%'")
def substring_search(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return substrings.search(substrings.build(d, "doc_id", "text"), d, "doc_id", "text", "License, version").select("doc_id", "source")


@query(
    "substring_batch",
    """WITH p AS (SELECT item_id, CASE item_id % 10 WHEN 0 THEN '%_' WHEN 1 THEN 'É' ELSE array_to_string(string_split(text, ' ')[2:3], ' ') END AS pattern FROM benchmark)
SELECT item_id, doc_id FROM p JOIN documents ON length(pattern) > 0 AND contains(lower(text), lower(pattern))""",
)
def substring_batch(spark, sf_dir):
    """Which documents hold two words of each test item, one letter, or signs that are wildcards elsewhere."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.col("item_id") % 10
    pattern = F.when(kind == 0, "%_").when(kind == 1, "É").otherwise(F.array_join(F.slice(F.split("text", " "), 2, 2), " "))
    patterns = read(spark, sf_dir, "benchmark").select("item_id", pattern.alias("pattern"))
    return substrings.search_batch(substrings.build(d, "doc_id", "text"), d, "doc_id", "text", patterns, "item_id", "pattern")


_DICTIONARY_SQL = """w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
dictionary AS (SELECT DISTINCT array_to_string(w[item_id % 7 + 1:item_id % 7 + 1 + item_id % 3], ' ') AS phrase, 'set ' || item_id % 5 AS concept, (1 + item_id % 3)::DOUBLE AS weight FROM w
  UNION SELECT * FROM (VALUES ('of the', 'short', 0.5), ('de la', 'short', 0.5), ('the', 'short', 0.25), ('est', 'short', 0.25), ('in der', 'short', 0.5)))"""


@query(
    "phrase_scores",
    f"""WITH {_DICTIONARY_SQL},
told AS (SELECT phrase, ' ' || replace(phrase, ' ', '  ') || ' ' AS spaced FROM (SELECT DISTINCT phrase FROM dictionary)),
pattern AS (SELECT '(' || string_agg(spaced, '|' ORDER BY length(spaced) DESC, spaced) || ')' AS p FROM told),
t AS (SELECT conv_id, turn, ' ' || replace(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' ' AS t FROM conversations WHERE text IS NOT NULL),
hits AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, p)) AS spaced FROM t, pattern)
SELECT conv_id, turn, concept, COUNT(*) AS n, SUM(weight) AS score FROM hits JOIN told USING (spaced) JOIN dictionary USING (phrase) GROUP BY conv_id, turn, concept""",
)
def phrase_scores(spark, sf_dir):
    """How often phrases of one to three words of the test items, and some short ones, stand in each turn of the conversations."""
    k = F.col("item_id")
    own = F.split(F.trim(F.regexp_replace(F.lower("text"), phrases.GAP, " ")), " ")
    phrase = F.array_join(F.slice(own, (k % 7 + 1).cast("int"), (k % 3 + 1).cast("int")), " ")
    rows = read(spark, sf_dir, "benchmark").select(phrase.alias("phrase"), F.concat(F.lit("set "), (k % 5).cast("string")).alias("concept"), (k % 3 + 1).cast("double").alias("weight")).distinct()
    short = spark.createDataFrame([("of the", "short", 0.5), ("de la", "short", 0.5), ("the", "short", 0.25), ("est", "short", 0.25), ("in der", "short", 0.5)], "phrase string, concept string, weight double")
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return phrases.scores(turns, "key", "text", rows.unionByName(short)).select("key.conv_id", "key.turn", "concept", "n", "score")


_CODES = ", ".join(f"'{c}'" for c in PROBLEMS)
CODE_TEXT = "CASE conv_id % 4 WHEN 0 THEN 'Kendala: ' ELSE '' END || (1 + turn % 4)::VARCHAR || '.' || (1 + conv_id % 4)::VARCHAR || CASE WHEN conv_id % 3 = 0 THEN '.' || (1 + turn % 5)::VARCHAR ELSE '' END || ' ' || COALESCE(text, '')"
# keyword matches first, then bare ones; a histogram and a filter need the set alone
_CODE_ROWS = f"x AS (SELECT conv_id, turn, {CODE_TEXT} AS remark FROM conversations), y AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(remark, '\\b(\\d(?:\\.\\d+){{1,2}})\\b', 1)) AS code FROM x), z AS (SELECT * FROM y WHERE code IN ({_CODES}))"


def remarks(spark, sf_dir) -> DataFrame:
    """Conversation turns, a problem code written in front of each."""
    conv, turn = F.col("conv_id"), F.col("turn")
    number = lambda c: c.cast("long").cast("string")
    remark = F.concat(F.when(conv % 4 == 0, "Kendala: ").otherwise(""), number(turn % 4 + 1), F.lit("."), number(conv % 4 + 1), F.when(conv % 3 == 0, F.concat(F.lit("."), number(turn % 5 + 1))).otherwise(""), F.lit(" "), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", remark.alias("remark"))


@query("code_extract", f"WITH {_CODE_ROWS} SELECT conv_id, turn, code FROM z")
def code_extract(spark, sf_dir):
    r = remarks(spark, sf_dir)
    return r.select("conv_id", "turn", F.explode(X.problem_codes(F.col("remark"))).alias("code"))


@query("code_histogram", f"WITH {_CODE_ROWS} SELECT code, COUNT(*) AS n FROM z GROUP BY code")
def code_histogram(spark, sf_dir):
    r = remarks(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return search.code_histogram(r, "key", ["remark"])


@query("code_filter", f"WITH {_CODE_ROWS} SELECT conv_id, turn FROM z WHERE code = '2.3'")
def code_filter(spark, sf_dir):
    return remarks(spark, sf_dir).where(F.array_contains(X.problem_codes(F.col("remark")), "2.3")).select("conv_id", "turn")


@query(
    "code_search",
    "WITH codes(code, name, words) AS (VALUES " + ", ".join(f"('{c}', '{n}', [{', '.join(repr(w) for w in V.PROBLEM_WORDS[c])}])" for c, n in PROBLEMS.items()) + """),
asked AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'DATA' WHEN 1 THEN '1.1' WHEN 2 THEN '2.4' ELSE string_split(text, ' ')[-1] END AS asked FROM conversations),
scored AS (SELECT conv_id, turn, code, name, CASE WHEN code = asked THEN 100 WHEN contains(code, asked) THEN 90 ELSE 0 END + CASE WHEN contains(lower(name), trim(lower(asked))) THEN 50 ELSE 0 END
           + CASE WHEN len(list_filter(words, lambda w: contains(lower(w), trim(lower(asked))))) > 0 THEN 30 ELSE 0 END AS score FROM asked, codes WHERE asked IS NOT NULL)
SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, code) <= 3""",
)
def code_search(spark, sf_dir):
    kind = F.col("turn") % 4
    asked = F.when(kind == 0, "DATA").when(kind == 1, "1.1").when(kind == 2, "2.4").otherwise(F.element_at(F.split("text", " "), -1))
    rows = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), asked.alias("asked"))
    return search.code_search(rows, "key", "asked").select("key.conv_id", "key.turn", "code", "name", "score")


@query("code_categories", f"WITH {_CODE_ROWS} SELECT CASE WHEN code LIKE '1.1%' THEN 'Technical > Subsurface' ELSE 'Technical > Non Subsurface' END AS category, COUNT(*) AS n FROM z WHERE code LIKE '1.%' GROUP BY 1")
def code_categories(spark, sf_dir):
    rows = remarks(spark, sf_dir).select(F.explode(X.problem_codes(F.col("remark"))).alias("code"))
    # the table of codes is fixed and small
    return rows.join(F.broadcast(search.codes_in_category(spark, "technical")), "code").groupBy("category").agg(F.count("*").alias("n"))


@query("code_snippets", f"WITH {_CODE_ROWS} SELECT z.conv_id, z.turn, code, trim(substr(remark, GREATEST(1, instr(remark, code) - 50), instr(remark, code) - GREATEST(1, instr(remark, code) - 50) + len(code) + 50)) AS snippet FROM z JOIN x ON z.conv_id = x.conv_id AND z.turn = x.turn")
def code_snippets(spark, sf_dir):
    r = remarks(spark, sf_dir)
    rows = r.select("conv_id", "turn", "remark", F.explode(X.problem_codes(F.col("remark"))).alias("code"))
    return rows.select("conv_id", "turn", "code", search.snippet(F.col("remark"), F.col("code")).alias("snippet"))


QUERY_VECTOR = [round(((i * 37) % 17 - 8) / 8, 3) for i in range(64)]
_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_COS = f"list_dot_product(embedding::DOUBLE[], {_QV}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QV}, {_QV})))"


@query("cosine_topk", f"SELECT vec_id, ROUND({_COS}, 4) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return search.top_similar(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 20)


@query("cosine_filtered", f"SELECT vec_id, ROUND({_COS}, 4) AS similarity FROM embeddings WHERE label IN (1, 2) ORDER BY similarity DESC, vec_id LIMIT 10")
def cosine_filtered(spark, sf_dir):
    return search.top_similar(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 10, F.col("label").isin(1, 2))


_COSINE_PAIR = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


@query(
    "vector_topk_batch",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, {_COSINE_PAIR} AS c FROM q, embeddings e)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id))::INT AS rank, vec_id, ROUND(c, 6) AS similarity FROM s QUALIFY rank <= 10""",
)
def vector_topk_batch(spark, sf_dir):
    """Every fiftieth vector asks all vectors; all lists are probed, so the SQL holds."""
    e = read(spark, sf_dir, "embeddings")
    found = vectors.top_k(vectors.build(e, "vec_id", "embedding"), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return rounded(found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "similarity"), similarity=6)


@query(
    "embed_documents",
    r"""WITH RECURSIVE bits AS (SELECT i AS entry, i::BIGINT AS value, 0 AS step FROM range(256) t(i) UNION ALL SELECT entry, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(value ORDER BY entry) AS entries FROM bits WHERE step = 8),
w AS MATERIALIZED (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '\s+'), lambda x: x <> '')) AS word FROM documents),
coded AS MATERIALIZED (SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c // 256, entries[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) AS code
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM w), crc),
counts AS (SELECT doc_id, code % 32 AS place, SUM(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS n FROM w JOIN coded USING (word) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(SUM(n * n)) AS norm FROM counts GROUP BY doc_id)
SELECT d.doc_id, i::INT AS place, ROUND(COALESCE(n, 0) / greatest(COALESCE(norm, 0), 1e-9::DOUBLE), 5) AS weight
FROM documents d CROSS JOIN range(32) r(i) LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.place = i LEFT JOIN norms m ON m.doc_id = d.doc_id""",
)
def embed_documents(spark, sf_dir):
    """Every number of every document's vector."""
    vector = search.hashed_vector(F.col("text"), 32)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(vector).alias("place", "weight"))
    return rounded(rows, weight=5)


@query("contextual_filter", f"WITH {SNAPSHOTS} SELECT project_id, report_year FROM snap WHERE report_year = 1997 AND wk_name ILIKE '%nation_1%' AND province ILIKE '%province 1%' AND project_stage ILIKE '%explo%'")
def contextual_filter(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    return rows.where(search.contextual(rows, {"report_year": 1997, "wk_name": "nation_1", "province": "province 1", "project_stage": "explo"})).select("project_id", "report_year")


@query("concept_total", f"WITH {SNAPSHOTS} SELECT ROUND(SUM(res_oc), 2) AS oil_condensate, ROUND(SUM(res_an), 2) AS gas FROM snap WHERE report_year = (SELECT MAX(report_year) FROM snap) AND wk_name LIKE '%NATION_1%' AND uncert_level = '{LOW}'")
def concept_total(spark, sf_dir):
    return rounded(analysis.concept_total(snapshots(spark, sf_dir), ("res_oc", "res_an"), ("wk_name", "NATION_1"), "1P"), oil_condensate=2, gas=2)


@query("shown_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE format('{:,.2f}', o_totalprice) || ' MSTB (Thousand Stock Tank Barrels)' END AS shown FROM orders")
def shown_values(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.shown_value(value, "MSTB").alias("shown"))


@query("shortened_texts", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text FROM documents")
def shortened_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text")).alias("text"))


# ---------------------------------------------------------------- graph, entities, ids

def trade_graph(spark, sf_dir) -> graph.Graph:
    r, n, c, o = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    g = graph.Graph()
    g.add_nodes("region", r, "r_regionkey", "r_name").add_nodes("nation", n, "n_nationkey", "n_name").add_nodes("customer", c, "c_custkey", "c_name").add_nodes("order", o, "o_orderkey", "o_totalprice")
    g.add_edges("in_region", n, "n_nationkey", "n_regionkey").add_edges("in_nation", c, "c_custkey", "c_nationkey").add_edges("placed", o, "o_custkey", "o_orderkey")
    return g


@query("graph_two_hop", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def graph_two_hop(spark, sf_dir):
    m = trade_graph(spark, sf_dir).start("customer", "c").step("in_nation", "nation", "n").step("in_region", "region", "r")
    return m.rows.select(F.col("c_c_name").alias("c_name"), F.col("n_n_name").alias("n_name"), F.col("r_r_name").alias("r_name"))


@query("graph_optional", "SELECT c_custkey, COUNT(o_orderkey) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def graph_optional(spark, sf_dir):
    m = trade_graph(spark, sf_dir).start("customer", "c").step("placed", "order", "o", optional=True)
    return m.rows.groupBy(F.col("c_id").alias("c_custkey")).agg(F.count("o_id").alias("n_orders"), F.round(F.sum("o_o_totalprice"), 2).alias("total"))


@query("graph_reverse", "SELECT r_name, COUNT(*) AS n_customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def graph_reverse(spark, sf_dir):
    m = trade_graph(spark, sf_dir).start("region", "r").step("in_region", "nation", "n", reverse=True).step("in_nation", "customer", "c", reverse=True)
    return m.rows.groupBy(F.col("r_r_name").alias("r_name")).agg(F.count("*").alias("n_customers"))


def domain_graph(spark, sf_dir) -> graph.Graph:
    snap = snapshots(spark, sf_dir)
    for c in ("is_pse_approved", "is_pod_approved"):
        snap = snap.withColumn(c, F.col("project_isactive"))
    return graph.resource_graph(snap.withColumn("dcpy_gtr_oc", F.col("dcpy_uc_oc")), forecast_rows(spark, sf_dir), 60.0)


FIELD_OF = "field_name = 'Field 7' AND report_year = 1997"


@query("graph_field_status", f"WITH {SNAPSHOTS} SELECT field_name, MIN(wk_name) OVER () AS wk_name, project_stage, project_class, onstream_year, report_status, project_isactive AS is_pse_approved, project_isactive AS is_pod_approved, ROUND(res_oc, 2) AS res_oc, ROUND(res_an, 2) AS res_an FROM (SELECT * REPLACE ((SELECT MIN(wk_name) FROM snap WHERE field_name = 'Field 7') AS wk_name) FROM snap) WHERE {FIELD_OF} AND uncert_level = '{MIDDLE}'")
def graph_field_status(spark, sf_dir):
    return rounded(graph.field_status(domain_graph(spark, sf_dir), "Field 7", 1997), res_oc=2, res_an=2)


@query("graph_field_reserves", f"WITH {SNAPSHOTS} SELECT field_name, uncert_level, ROUND(res_oc, 2) AS res_oc, ROUND(res_an, 2) AS res_an, ROUND(eur_res_oc, 2) AS eur_res_oc, ROUND(eur_res_an, 2) AS eur_res_an, report_date, report_status FROM snap WHERE {FIELD_OF}")
def graph_field_reserves(spark, sf_dir):
    return rounded(graph.field_reserves(domain_graph(spark, sf_dir), "Field 7", 1997), res_oc=2, res_an=2, eur_res_oc=2, eur_res_an=2)


@query("graph_field_issues", f"WITH {SNAPSHOTS} SELECT field_name, project_remarks, vol_remarks, report_status FROM snap WHERE {FIELD_OF}")
def graph_field_issues(spark, sf_dir):
    return graph.field_issues(domain_graph(spark, sf_dir), "Field 7", 1997)


@query("graph_area_reserves", f"WITH {SNAPSHOTS}, own AS (SELECT DISTINCT field_id FROM snap WHERE wk_name = 'NATION_3') SELECT 'NATION_3' AS wk_name, ROUND(SUM(res_oc), 2) AS res_oc, ROUND(SUM(res_an), 2) AS res_an, ROUND(SUM(eur_res_oc), 2) AS eur_res_oc, ROUND(SUM(eur_res_an), 2) AS eur_res_an FROM snap JOIN own USING (field_id) WHERE report_year = 1997 AND uncert_level = '{MIDDLE}'")
def graph_area_reserves(spark, sf_dir):
    return rounded(graph.area_reserves(domain_graph(spark, sf_dir), "NATION_3", 1997), res_oc=2, res_an=2, eur_res_oc=2, eur_res_an=2)


@query("graph_field_recovery", f"WITH {SNAPSHOTS} SELECT field_name, ROUND(SUM(prj_ioip), 2) AS ioip, ROUND(SUM(prj_igip), 2) AS igip, ROUND(CASE WHEN SUM(prj_ioip) > 0 THEN SUM(cprd_sls_oil) / SUM(prj_ioip) ELSE 0 END, 6) AS rf_oil, ROUND(CASE WHEN SUM(prj_igip) > 0 THEN SUM(cprd_sls_gn) / SUM(prj_igip) ELSE 0 END, 6) AS rf_gas FROM snap WHERE {FIELD_OF} AND uncert_level = '{MIDDLE}' GROUP BY field_name")
def graph_field_recovery(spark, sf_dir):
    return rounded(graph.field_recovery(domain_graph(spark, sf_dir), "Field 7", 1997), ioip=2, igip=2, rf_oil=6, rf_gas=6)


@query("graph_field_changes", f"WITH {SNAPSHOTS} SELECT field_name, ROUND(dcpy_um_oc, 2) AS update_model, ROUND(dcpy_ppa_oc, 2) AS production_analysis, ROUND(dcpy_wi_oc, 2) AS well_intervention, ROUND(dcpy_uc_oc, 2) AS commerciality_change, ROUND(dcpy_uc_oc, 2) AS unaccounted, project_remarks FROM snap WHERE {FIELD_OF}")
def graph_field_changes(spark, sf_dir):
    names = ("update_model", "production_analysis", "well_intervention", "commerciality_change", "unaccounted")
    return rounded(graph.field_changes(domain_graph(spark, sf_dir), "Field 7", 1997), **{c: 2 for c in names})


def _of_series(columns: tuple[str, ...]) -> str:
    return f"WITH {FORECAST_SQL} SELECT year, {', '.join(f'ROUND(SUM({c}), 2) AS {c}' for c in columns)} FROM rows_ WHERE field_id = 7 AND report_year = 2024 GROUP BY year"


@query("graph_field_production", _of_series(("rate_oil", "rate_gn", "rate_oc", "rate_an")))
def graph_field_production(spark, sf_dir):
    return rounded(graph.field_production(domain_graph(spark, sf_dir), "Field 7", 2024), rate_oil=2, rate_gn=2, rate_oc=2, rate_an=2)


@query("graph_field_forecast", _of_series(("tpf_oc", "tpf_an", "slf_oc", "slf_an")))
def graph_field_forecast(spark, sf_dir):
    return rounded(graph.field_forecast(domain_graph(spark, sf_dir), "Field 7", 2024), tpf_oc=2, tpf_an=2, slf_oc=2, slf_an=2)


@query("graph_near_fields", f"WITH {SNAPSHOTS}, g AS (SELECT field_id, MIN(field_name) AS field_name, MIN(field_lat) AS lat, MIN(field_long) AS long FROM snap GROUP BY field_id) SELECT y.field_name, ROUND({_km('x', 'y')}, 4) AS km FROM g x JOIN g y ON x.field_name = 'Field 7' AND x.field_id <> y.field_id AND {_km('x', 'y')} <= 60.0")
def graph_near_fields(spark, sf_dir):
    return rounded(graph.fields_near(domain_graph(spark, sf_dir), "Field 7"), km=4)


@query("entity_confidence", "SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'part#7' THEN 1.0::DOUBLE WHEN starts_with(lower(p_name), 'part#7') THEN 0.9::DOUBLE WHEN contains(lower(p_name), 'part#7') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM part")
def entity_confidence(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", X.match_confidence(F.col("p_name"), "part#7").alias("confidence"))


@query("entity_candidates", "SELECT c_custkey, c_name, CASE WHEN starts_with(lower(c_name), '1') THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM customer WHERE contains(lower(c_name), '11') ORDER BY confidence DESC, c_name, c_custkey LIMIT 10")
def entity_candidates(spark, sf_dir):
    return resolve.candidates(read(spark, sf_dir, "customer"), "c_custkey", "c_name", "11")


def _stands(words) -> str:
    return r"(?:^|[^\p{L}\p{N}])(" + "|".join(words) + r")(?:[^\p{L}\p{N}]|$)"


# a question is written in front of each turn's own words, so that every kind of year and word occurs
ASKED = "CASE conv_id % 5 WHEN 0 THEN 'tahun ' || (2000 + turn) WHEN 1 THEN 'data ' || (1990 + turn * 5) || ' minyak' WHEN 2 THEN 'tahun ' || (10 + turn) || ' gas 2P' WHEN 3 THEN 'gasoline 3p contingent eksplorasi' ELSE 'low flow' END"


# words with the one before them; per reading of a year the first word that fits
_YEARS = r"""w AS (SELECT *, regexp_split_to_array(trim(regexp_replace(lower(asked), '(tahun|year)', ' \1 ', 'g')), '\s+') AS w FROM q),
y AS (SELECT *, list_filter(range(1, len(w) + 1), lambda k: k > 1 AND w[k - 1] = 'tahun' AND regexp_matches(w[k], '^[0-9]{4}'))[1] AS k1,
             list_filter(range(1, len(w) + 1), lambda k: k > 1 AND w[k - 1] = 'year' AND regexp_matches(w[k], '^[0-9]{4}'))[1] AS k2,
             list_filter(range(1, len(w) + 1), lambda k: regexp_matches(w[k], '^[0-9]{4}$'))[1] AS k3,
             list_filter(range(1, len(w) + 1), lambda k: k > 1 AND w[k - 1] = 'tahun' AND regexp_matches(w[k], '^[0-9]{2}([^0-9]|$)'))[1] AS k4 FROM w),
z AS (SELECT *, list_filter([TRY_CAST(left(w[k1], 4) AS INT), TRY_CAST(left(w[k2], 4) AS INT), TRY_CAST(w[k3] AS INT), 2000 + TRY_CAST(left(w[k4], 2) AS INT)], lambda v: v BETWEEN 2000 AND 2100)[1] AS year FROM y)"""


@query(
    "question_resolution",
    f"""WITH q AS (SELECT conv_id, turn, {ASKED} || ' ' || COALESCE(text, '') AS asked FROM conversations), {_YEARS}
SELECT conv_id, turn, year,
       CASE WHEN regexp_matches(lower(asked), '{_stands(resolve.OIL_WORDS)}') THEN 'oil' WHEN regexp_matches(lower(asked), '{_stands(resolve.GAS_WORDS)}') THEN 'gas' END AS substance,
       CASE WHEN regexp_matches(lower(asked), '{_stands(resolve.LEVEL_WORDS[LOW])}') THEN '{LOW}' WHEN regexp_matches(lower(asked), '{_stands(resolve.LEVEL_WORDS[MIDDLE])}') THEN '{MIDDLE}'
            WHEN regexp_matches(lower(asked), '{_stands(resolve.LEVEL_WORDS[HIGH])}') THEN '{HIGH}' END AS level,
       CASE WHEN regexp_matches(lower(asked), '{_stands(["contingent"])}') THEN '2. Contingent Resources' END AS class,
       CASE WHEN regexp_matches(lower(asked), '{_stands(["eksplorasi"])}') THEN 'Exploration' END AS stage
FROM z""",
)
def question_resolution(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    number = lambda c: c.cast("long").cast("string")
    asked = (
        F.when(conv % 5 == 0, F.concat(F.lit("tahun "), number(turn + 2000)))
        .when(conv % 5 == 1, F.concat(F.lit("data "), number(turn * 5 + 1990), F.lit(" minyak")))
        .when(conv % 5 == 2, F.concat(F.lit("tahun "), number(turn + 10), F.lit(" gas 2P")))
        .when(conv % 5 == 3, "gasoline 3p contingent eksplorasi")
        .otherwise("low flow")
    )
    asked = F.concat(asked, F.lit(" "), F.coalesce("text", F.lit("")))
    q = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), asked.alias("asked"))
    return resolve.resolve(q, "key", "asked").select("key.conv_id", "key.turn", "year", "substance", "level", "class", "stage")


def name_table(spark, sf_dir) -> DataFrame:
    """Names that a question may hold: of customers as fields, of nations as work areas, of segments as operators."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    kinds = [c.select(F.lit("Field").alias("kind"), F.col("c_name").alias("name")), n.select(F.lit("WorkingArea").alias("kind"), F.col("n_name").alias("name")), c.select(F.lit("Operator").alias("kind"), F.col("c_mktsegment").alias("name")).distinct()]
    return reduce(DataFrame.unionByName, kinds)


def name_questions(spark, sf_dir, year: int = 1997) -> DataFrame:
    """A question for each customer, by turns about the customer in a year, two nations, its segment's rates, or nothing known."""
    k = F.col("c_custkey")
    asked = F.when(k % 5 == 0, F.concat(F.lit(f"tahun {year} cadangan 2P "), F.lower("c_name"), F.lit(", "), "c_mktsegment")).when(k % 5 == 1, F.concat(F.lit("produksi nation_"), (k % 25).cast("string"), F.lit(" dan nation_"), ((k + 1) % 25).cast("string")))
    asked = asked.when(k % 5 == 2, F.concat(F.lit("forecast nation_"), (k % 25).cast("string"), F.lit("?"))).when(k % 5 == 3, F.concat(F.lit("rate: "), "c_mktsegment")).otherwise("lapangan besar")
    return read(spark, sf_dir, "customer").select("c_custkey", asked.alias("asked"))


NAME_QUESTIONS = """q AS (SELECT c_custkey, c_custkey % 5 AS kind_no, c_name, c_mktsegment FROM customer)"""


@query(
    "name_resolution",
    """WITH k AS (SELECT *, c_custkey % 5 AS k FROM customer),
q AS (SELECT c_custkey, CASE k WHEN 0 THEN 'tahun 1997 cadangan 2P ' || lower(c_name) || ', ' || c_mktsegment WHEN 1 THEN 'produksi nation_' || (c_custkey % 25) || ' dan nation_' || ((c_custkey + 1) % 25)
       WHEN 2 THEN 'forecast nation_' || (c_custkey % 25) || '?' WHEN 3 THEN 'rate: ' || c_mktsegment ELSE 'lapangan besar' END AS asked FROM k),
names AS (SELECT 1 AS place, 'Field' AS kind, c_name AS name FROM customer UNION SELECT 2, 'WorkingArea', n_name FROM nation UNION SELECT 3, 'Operator', c_mktsegment FROM customer),
spaced AS (SELECT *, ' ' || regexp_replace(lower(asked), '[\\s,.;:!?"()]+', ' ', 'g') || ' ' AS words FROM q),
hits AS (SELECT c_custkey, place, kind, name, len(string_split(name, ' ')) AS n_words FROM spaced JOIN names ON instr(words, ' ' || lower(name) || ' ') > 0),
best AS (SELECT * FROM hits QUALIFY rank() OVER (PARTITION BY c_custkey ORDER BY place, n_words DESC) = 1),
per AS (SELECT c_custkey, COUNT(*) AS n, MIN(kind) AS kind, MIN(name) AS name FROM best GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'failed' WHEN n = 1 THEN 'success' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN kind END AS kind, CASE WHEN n = 1 THEN name END AS name,
       CASE WHEN n = 1 AND kind <> 'Operator' THEN CASE kind WHEN 'Field' THEN 'field_' ELSE 'wa_' END || CASE WHEN regexp_matches(words, '(^|[^\\p{L}\\p{N}])(produksi|forecast|profil|rate)([^\\p{L}\\p{N}]|$)') THEN 'timeseries' ELSE 'resources' END ELSE 'project_resources' END AS suggested_table,
       CASE WHEN n = 1 THEN CASE kind WHEN 'Field' THEN 'field_name' WHEN 'WorkingArea' THEN 'wk_name' ELSE 'operator_name' END END AS filter_column
FROM spaced LEFT JOIN per USING (c_custkey)""",
)
def name_resolution(spark, sf_dir):
    return resolve.resolve_names(name_questions(spark, sf_dir), "c_custkey", "asked", name_table(spark, sf_dir))


@query(
    "rows_of_questions",
    f"""WITH {NAME_QUESTIONS}, {PROJECTS}, hits AS (
SELECT q.c_custkey, p.rec_oc FROM q JOIN projects p ON kind_no = 0 AND p.field_name = q.c_name AND p.report_year + 100 = 2097 AND p.uncert_level = '{MIDDLE}' AND p.project_id % 3 > 0
UNION ALL SELECT q.c_custkey, p.rec_oc FROM q JOIN projects p ON kind_no = 2 AND p.wk_name = 'NATION_' || (q.c_custkey % 25))
SELECT c_custkey, COUNT(*) AS n, ROUND(SUM(rec_oc), 2) AS rec_oc FROM hits GROUP BY c_custkey""",
)
def rows_of_questions(spark, sf_dir):
    q = spread(name_questions(spark, sf_dir, 2097))
    named = resolve.resolve_names(q, "c_custkey", "asked", name_table(spark, sf_dir)).join(resolve.resolve(q, "c_custkey", "asked"), "c_custkey")
    # the table's years are a century later, where a question's years are, and its classes those that a question asks for
    classes = F.when(F.col("project_id") % 3 > 0, V.CLASSES["cadangan"]).otherwise(V.CLASSES["contingent"])
    later = projects(spark, sf_dir).withColumns({"report_year": F.col("report_year") + 100, "project_class": classes})
    totals = resolve.totals_asked_for(named, "c_custkey", later, "rec_oc")
    return totals.select("c_custkey", "n", F.round("total", 2).alias("rec_oc"))


@query("entity_rows", f"WITH {PROJECTS} SELECT project_id FROM projects WHERE report_year = 1997 AND wk_name = 'NATION_3' AND uncert_level = '{HIGH}'")
def entity_rows(spark, sf_dir):
    rows = projects(spark, sf_dir)
    return rows.where(resolve.entity_filter(rows, {"year": 1997, "working_area": "NATION_3", "level": HIGH})).select("project_id")


_PHRASES = ["potensi eksplorasi minyak", "potensi lapangan", "cadangan gas", "sumber daya", "potensi proyek", "contingent", "grr", "apa saja"]


@query(
    "question_columns",
    """WITH q AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, CASE turn % 2 WHEN 0 THEN 'field_resources' ELSE 'project_resources' END AS table_name FROM conversations),
v AS (SELECT *, ['prospective', 'potensi', 'cadangan', 'sumber_daya', 'sumber_daya', 'contingent', 'sumber_daya', 'cadangan'][k + 1] AS volume, CASE WHEN k IN (2, 7) THEN 'res_' ELSE 'rec_' END AS p,
      CASE WHEN k = 0 AND table_name = 'field_resources' THEN '_risked' ELSE '' END AS s FROM q)
SELECT conv_id, turn, volume, p || CASE k WHEN 0 THEN 'oil' WHEN 2 THEN 'ga' ELSE 'oc' END || s AS oil, p || CASE k WHEN 0 THEN 'con' WHEN 2 THEN 'gn' ELSE 'an' END || s AS gas FROM v""",
)
def question_columns(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    asked = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), ((conv + turn) % 8 + 1).cast("int"))
    table = F.when(turn % 2 == 0, "field_resources").otherwise("project_resources")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", resolve.asked_columns(asked, table).alias("c")).select("conv_id", "turn", "c.volume", "c.oil", "c.gas")


_DIGIT = """list_sum(list_transform(range(1, 7), lambda i: CASE WHEN (6 - i) % 2 = 0 THEN CASE WHEN 2 * d(i) >= 16 THEN 2 * d(i) - 15 ELSE 2 * d(i) END ELSE d(i) END))""".replace("d(i)", "(instr('0123456789ABCDEF', payload[i]) - 1)")


@query("check_digits", f"WITH x AS (SELECT c_custkey, lpad(upper(to_hex(c_custkey)), 6, '0') AS payload FROM customer) SELECT c_custkey, payload, '0123456789ABCDEF'[1 + ((16 - ({_DIGIT})::INT % 16) % 16)] AS digit FROM x")
def check_digits(spark, sf_dir):
    payload = F.lpad(F.hex("c_custkey"), 6, "0")
    return read(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"), X.check_digit(payload).alias("digit"))


def _digit_of(payload: str, size: int) -> str:
    """The check digit in SQL: every second digit from the end counts twice, less 15 from 16 on."""
    d = f"(instr('0123456789ABCDEF', {payload}[i]) - 1)"
    total = f"list_sum(list_transform(range(1, {size + 1}), lambda i: CASE WHEN ({size} - i) % 2 = 0 THEN CASE WHEN 2 * {d} >= 16 THEN 2 * {d} - 15 ELSE 2 * {d} END ELSE {d} END))"
    return f"'0123456789ABCDEF'[1 + ((16 - ({total})::INT % 16) % 16)]"


ID_ROWS = f"""x AS (SELECT c_custkey, lpad(upper(to_hex(c_custkey % 256)), 2, '0') AS grid, lpad((c_custkey * 7 % 10000)::VARCHAR, 4, '0') AS suffix FROM customer),
made AS (SELECT *, grid || suffix AS payload, '0123456789ABCDEF'[1 + c_custkey % 16] AS given FROM x),
checked AS (SELECT *, {_digit_of('payload', 6)} AS digit, len(list_distinct(string_split(suffix, ''))) = 4 AS differ FROM made)"""


def id_rows(spark, sf_dir) -> DataFrame:
    """Field ids from a rule over customers: some with repeated digits, most with a wrong check digit."""
    k = F.col("c_custkey")
    grid, suffix = F.lpad(F.hex(k % 256), 2, "0"), F.lpad((k * 7 % 10000).cast("string"), 4, "0")
    given = F.hex(k % 16)
    made = F.concat(F.lit("f-"), F.lower(grid), F.lit("-"), suffix, F.lit("-"), given)
    return read(spark, sf_dir, "customer").select("c_custkey", grid.alias("grid"), suffix.alias("suffix"), made.alias("field_id"))


@query("id_verify", f"WITH {ID_ROWS} SELECT c_custkey, digit, differ AND digit = given AS is_valid FROM checked")
def id_verify(spark, sf_dir):
    rows = id_rows(spark, sf_dir)
    return rows.select("c_custkey", X.check_digit(F.concat("grid", "suffix")).alias("digit"), X.valid_field_id(F.col("field_id")).alias("is_valid"))


@query(
    "ids_of_fields",
    f"""WITH {ID_ROWS}, used AS (SELECT DISTINCT grid, suffix FROM checked WHERE differ AND digit = given),
wanted AS (SELECT grid, COUNT(*) % 3 + 1 AS total FROM checked GROUP BY grid),
every AS (SELECT lpad(n::VARCHAR, 4, '0') AS suffix FROM range(10000) t(n) WHERE len(list_distinct(string_split(lpad(n::VARCHAR, 4, '0'), ''))) = 4),
free AS (SELECT grid, suffix, total, row_number() OVER (PARTITION BY grid ORDER BY suffix) AS k FROM wanted, every WHERE (grid, suffix) NOT IN (SELECT (grid, suffix) FROM used)),
given AS (SELECT grid, suffix, grid || suffix AS payload FROM free WHERE k <= total)
SELECT grid, 'F-' || grid || '-' || suffix || '-' || {_digit_of('payload', 6)} AS field_id FROM given""",
)
def ids_of_fields(spark, sf_dir):
    rows = id_rows(spark, sf_dir)
    wanted = rows.groupBy("grid").agg((F.count("*") % 3 + 1).alias("total"))
    return ids.next_field_ids(wanted, rows)


_ZONES = f"""WITH {ID_ROWS}, valid AS (SELECT c_custkey, payload || digit AS field FROM checked WHERE differ)"""


@query(
    "ids_of_projects",
    f"""{_ZONES} SELECT 'F-' || field[1:2] || '-' || field[3:6] || '-' || field[7] AS field_id, 'P-' || field || '-' || lpad((n + 1)::VARCHAR, 2, '0') AS project_id
FROM (SELECT field, SUM(1 + c_custkey % 2)::BIGINT AS total FROM valid GROUP BY field), range(99) t(n) WHERE n < total""",
)
def ids_of_projects(spark, sf_dir):
    rows = id_rows(spark, sf_dir)
    field = F.concat(F.lit("F"), "grid", "suffix", X.check_digit(F.concat("grid", "suffix")))
    wanted = rows.select(field.alias("field_id"), (F.col("c_custkey") % 2 + 1).alias("total")).where(X.valid_field_id(F.col("field_id")))
    return ids.next_project_ids(wanted, rows.select(F.lit(None).cast("string").alias("project_id")).limit(0))


@query(
    "ids_of_zones",
    f"""{_ZONES}, every AS (SELECT lpad(n::VARCHAR, 3, '0') AS suffix FROM range(1000) t(n) WHERE len(list_distinct(string_split(lpad(n::VARCHAR, 3, '0'), ''))) = 3),
wanted AS (SELECT field, COUNT(*) AS total FROM valid GROUP BY field),
given AS (SELECT field, suffix, field || suffix AS payload, total, row_number() OVER (PARTITION BY field ORDER BY suffix) AS k FROM wanted, every)
SELECT 'F-' || field[1:2] || '-' || field[3:6] || '-' || field[7] AS field_id, 'Z-' || field || '-' || suffix || '-' || {_digit_of('payload', 10)} AS zone_id FROM given WHERE k <= total""",
)
def ids_of_zones(spark, sf_dir):
    rows = id_rows(spark, sf_dir)
    field = F.concat(F.lit("F"), "grid", "suffix", X.check_digit(F.concat("grid", "suffix")))
    wanted = rows.select(field.alias("field_id"), F.lit(1).alias("total")).where(X.valid_field_id(F.col("field_id")))
    return ids.next_zone_ids(wanted, rows.select(F.lit(None).cast("string").alias("zone_id")).limit(0))


# ---------------------------------------------------------------- windows over events

@query("event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    w = rounded(streams.windowed(read(spark, sf_dir, "events")), total=2)
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL 30 MINUTE OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
