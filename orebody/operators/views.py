"""Detail-level views: which columns, which rows, in which order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.expressions import contains_text
from orebody.functions.vocabulary import family

#: Columns that every view shows, where the table has them.
ALWAYS = ("report_year", "report_status", "is_offshore", "wk_name", "field_name", "project_name", "project_stage", "project_class", "project_level", "uncert_level")
#: Columns of each level of detail and the names that a view gives them.
DETAILS: dict[str, dict[str, str]] = {
    "reserves": {"res_oc": "reserves_mstb", "res_an": "reserves_bscf"},
    "resources": {"rec_oc_risked": "resources_mstb", "rec_an_risked": "resources_bscf", "res_oc": "reserves_mstb", "res_an": "reserves_bscf"},
    "resources_risked": {"rec_oc_risked": "resources_mstb", "rec_an_risked": "resources_bscf", "res_oc": "reserves_mstb", "res_an": "reserves_bscf"},
    "inplace": {"prj_ioip": "ioip", "prj_igip": "igip"},
    "cumprod": {c: c for c in (*family("cprd_grs"), *family("cprd_sls"))},
    "rate": {c: c for c in (*family("rate_grs"), *family("rate_sls"))},
}


@dataclass(frozen=True)
class View:
    details: tuple[str, ...] = ("resources",)
    columns: tuple[str, ...] = ()
    search: str | None = None
    search_column: str | None = None
    years: tuple[int, ...] = ()
    year_column: str = "report_year"
    order: tuple[str, ...] = ()


def apply_view(df: DataFrame, view: View) -> DataFrame:
    """Rows and columns of ``df`` that the view asks for; unknown names are errors, never text in a query."""
    unknown = [d for d in view.details if d != "all" and d not in DETAILS]
    missing = [c for c in (*view.columns, *view.order, *([view.search_column] if view.search_column else [])) if c not in df.columns]
    if unknown or missing:
        raise ValueError(f"no such detail: {unknown}; no such column: {missing}")
    if view.search and view.search_column:
        df = df.where(contains_text(F.col(view.search_column), view.search))
    if view.years:
        df = df.where(F.col(view.year_column).isin(*view.years))
    if view.order:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in view.order])
    if view.columns:
        return df.select(*view.columns)
    if "all" in view.details:
        return df
    named = {c: c for c in ALWAYS} | {c: alias for d in view.details for c, alias in DETAILS[d].items()}
    return df.select(*[F.col(c).alias(alias) for c, alias in named.items() if c in df.columns])
