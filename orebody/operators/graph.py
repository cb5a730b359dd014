"""A property graph as node and edge tables: a traversal is a chain of joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.expressions import guarded_ratio
from orebody.functions.vocabulary import MIDDLE
from orebody.operators.spatial import near_pairs


@dataclass
class Graph:
    """Nodes by kind (each with ``id``), edges by name (each with ``src`` and ``dst``)."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def add_nodes(self, kind: str, df: DataFrame, key: str, *properties: str) -> "Graph":
        self.nodes[kind] = df.select(F.col(key).alias("id"), *properties).where("id IS NOT NULL").dropDuplicates(["id"])
        return self

    def add_edges(self, name: str, df: DataFrame, src: str, dst: str, *properties: str) -> "Graph":
        self.edges[name] = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *properties).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
        return self

    def start(self, kind: str, name: str) -> "Match":
        return Match(self, _named(self.nodes[kind], name), name)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])


@dataclass
class Match:
    """Rows found so far; ``at`` is the node that the next step leaves from."""

    graph: Graph
    rows: DataFrame
    at: str

    def step(self, edge: str, kind: str, name: str, reverse: bool = False, optional: bool = False) -> "Match":
        """Along an edge (or against it) to nodes of a kind; an optional step keeps rows without one."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        hop = self.graph.edges[edge].select(F.col(a).alias("__from"), F.col(b).alias(f"{name}_id"))
        reached = hop.join(_named(self.graph.nodes[kind], name), f"{name}_id")
        joined = self.rows.join(reached, self.rows[f"{self.at}_id"] == reached["__from"], "left" if optional else "inner").drop("__from")
        return Match(self.graph, joined, name)

    def where(self, condition) -> "Match":
        return Match(self.graph, self.rows.where(condition), self.at)


def resource_graph(snapshot: DataFrame, series: DataFrame, near_km: float = 20.0) -> Graph:
    """The graph of the two base tables: fields, work areas, operators, projects, reports and series years.

    A report is a snapshot row; ``LOCATED_NEAR`` joins fields within ``near_km`` and
    carries the distance.  A field's place is the least one that its rows state.
    """
    g = Graph()
    fields = snapshot.where("field_id IS NOT NULL").groupBy("field_id").agg(F.min("field_name").alias("field_name"), F.min("wk_name").alias("wk_name"), F.min("field_lat").cast("double").alias("lat"), F.min("field_long").cast("double").alias("long"))
    g.add_nodes("Field", fields, "field_id", "field_name", "wk_name", "lat", "long")
    areas = snapshot.groupBy("wk_id").agg(F.min("wk_name").alias("wk_name"))
    g.add_nodes("WorkingArea", areas, "wk_id", "wk_name")
    g.add_nodes("Operator", snapshot.select("operator_name").distinct(), "operator_name")
    projects = snapshot.groupBy("project_id").agg(F.min("project_name").alias("project_name"))
    g.add_nodes("Project", projects, "project_id", "project_name")
    key = F.concat_ws("|", "project_id", "report_year", "uncert_level")
    reports = snapshot.withColumn("report_id", key)
    g.add_nodes("Report", reports, "report_id", *[c for c in snapshot.columns if c != "id"])
    years = series.withColumn("series_id", F.concat_ws("|", "project_id", "report_year", "project_class", "project_level", "year"))
    g.add_nodes("SeriesYear", years, "series_id", *[c for c in series.columns if c != "id"])
    g.add_edges("FIELD_IN_AREA", snapshot, "field_id", "wk_id")
    g.add_edges("AREA_HAS_OPERATOR", snapshot, "wk_id", "operator_name")
    g.add_edges("PROJECT_OF_FIELD", snapshot, "project_id", "field_id")
    g.add_edges("REPORT_OF_PROJECT", reports, "report_id", "project_id")
    g.add_edges("REPORT_OF_FIELD", reports, "report_id", "field_id")
    g.add_edges("SERIES_OF_FIELD", years, "series_id", "field_id")
    pairs = near_pairs(fields.select(F.col("field_id").alias("id"), "lat", "long"), near_km)
    g.add_edges("LOCATED_NEAR", pairs, "a", "b", "km")
    return g


def _field(g: Graph, name: str) -> Match:
    return g.start("Field", "f").where(F.col("f_field_name") == name)


def _reports(m: Match, year: int, level: str | None = None, optional: bool = True) -> Match:
    """On to a field's reports of a year; the conditions belong to the step, so that a field without one stays."""
    wanted = F.col("report_year") == year
    if level is not None:
        wanted = wanted & (F.col("uncert_level") == level)
    narrowed = Graph({**m.graph.nodes, "Report": m.graph.nodes["Report"].where(wanted)}, m.graph.edges)
    return Match(narrowed, m.rows, m.at).step("REPORT_OF_FIELD", "Report", "r", reverse=True, optional=optional)


def _series(m: Match, year: int) -> Match:
    nodes = {**m.graph.nodes, "SeriesYear": m.graph.nodes["SeriesYear"].where(F.col("report_year") == year)}
    return Match(Graph(nodes, m.graph.edges), m.rows, m.at).step("SERIES_OF_FIELD", "SeriesYear", "s", reverse=True)


def _shown(m: Match, field: tuple[str, ...], alias: str, columns: tuple[str, ...]) -> DataFrame:
    return m.rows.select(*[F.col(f"f_{c}").alias(c) for c in field], *[F.col(f"{alias}_{c}").alias(c) for c in columns])


def field_status(g: Graph, name: str, year: int) -> DataFrame:
    """A field, and its reports of a year at the middle level with stage, class, approvals and reserves."""
    m = _reports(_field(g, name), year, MIDDLE)
    return _shown(m, ("field_name", "wk_name"), "r", ("project_stage", "project_class", "onstream_year", "report_status", "is_pse_approved", "is_pod_approved", "res_oc", "res_an"))


def field_reserves(g: Graph, name: str, year: int) -> DataFrame:
    """A field's reserves at every level, with what its reports of a year say of themselves."""
    return _shown(_reports(_field(g, name), year), ("field_name",), "r", ("uncert_level", "res_oc", "res_an", "eur_res_oc", "eur_res_an", "report_date", "report_status"))


def field_production(g: Graph, name: str, year: int) -> DataFrame:
    """(year, rates) of a field's series in a report year, in the order of years."""
    rows = _shown(_series(_field(g, name), year), (), "s", ("year", "rate_oil", "rate_gn", "rate_oc", "rate_an"))
    return rows.groupBy("year").agg(*[F.sum(c).alias(c) for c in ("rate_oil", "rate_gn", "rate_oc", "rate_an")]).orderBy("year")


def field_forecast(g: Graph, name: str, year: int) -> DataFrame:
    """(year, forecasts) of a field's series in a report year, in the order of years."""
    rows = _shown(_series(_field(g, name), year), (), "s", ("year", "tpf_oc", "tpf_an", "slf_oc", "slf_an"))
    return rows.groupBy("year").agg(*[F.sum(c).alias(c) for c in ("tpf_oc", "tpf_an", "slf_oc", "slf_an")]).orderBy("year")


def field_issues(g: Graph, name: str, year: int) -> DataFrame:
    """A field's remarks in its reports of a year."""
    return _shown(_reports(_field(g, name), year, optional=True), ("field_name",), "r", ("project_remarks", "vol_remarks", "report_status"))


def area_reserves(g: Graph, name: str, year: int) -> DataFrame:
    """(wk_name, res_oc, res_an, eur_res_oc, eur_res_an): a work area's sums at the middle level in a year."""
    start = g.start("WorkingArea", "a").where(F.col("a_wk_name") == name).step("FIELD_IN_AREA", "Field", "f", reverse=True)
    m = _reports(start, year, MIDDLE, optional=False)
    return m.rows.groupBy(F.col("a_wk_name").alias("wk_name")).agg(*[F.sum(f"r_{c}").alias(c) for c in ("res_oc", "res_an", "eur_res_oc", "eur_res_an")])


def field_recovery(g: Graph, name: str, year: int) -> DataFrame:
    """A field's volumes in place at the middle level and its recovery factors in a year."""
    m = _reports(_field(g, name), year, MIDDLE)
    oil, gas = F.sum("r_prj_ioip"), F.sum("r_prj_igip")
    return m.rows.groupBy(F.col("f_field_name").alias("field_name")).agg(oil.alias("ioip"), gas.alias("igip"), guarded_ratio(F.sum("r_cprd_sls_oil"), oil).alias("rf_oil"), guarded_ratio(F.sum("r_cprd_sls_gn"), gas).alias("rf_gas"))


def field_changes(g: Graph, name: str, year: int) -> DataFrame:
    """A field's yearly changes by cause in its reports of a year."""
    m = _reports(_field(g, name), year)
    names = {"dcpy_um_oc": "update_model", "dcpy_ppa_oc": "production_analysis", "dcpy_wi_oc": "well_intervention", "dcpy_gtr_oc": "commerciality_change", "dcpy_uc_oc": "unaccounted"}
    return m.rows.select(F.col("f_field_name").alias("field_name"), *[F.col(f"r_{c}").alias(n) for c, n in names.items()], F.col("r_project_remarks").alias("project_remarks"))


def fields_near(g: Graph, name: str) -> DataFrame:
    """(field_name, km) of the fields that lie near a field, nearest first."""
    both = g.edges["LOCATED_NEAR"].unionByName(g.edges["LOCATED_NEAR"].select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km"))
    at = _field(g, name).rows.select(F.col("f_id").alias("src"))
    hop = both.join(at, "src", "left_semi").select(F.col("dst").alias("id"), "km")
    return hop.join(g.nodes["Field"], "id").select("field_name", "km").orderBy("km", "field_name")
