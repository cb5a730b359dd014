"""Hierarchical rollups from metadata: a level is its keys and what becomes of the rest.

Grouping keys are projected as they are, so that a filter on one reaches the scan; there
is no sort inside; sums of a higher level start from the level below.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orebody.functions.expressions import guarded_ratio
from orebody.functions.vocabulary import SERIES_SUMS, SNAPSHOT_SUMS

#: So many numbers of a group make it worth while to group its texts apart.
WIDE = 16


@dataclass(frozen=True)
class Level:
    keys: tuple[str, ...]
    least: tuple[str, ...] = ()
    greatest: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    means: tuple[str, ...] = ()
    averages: dict[str, str] = field(default_factory=dict)  # name -> column that is averaged under that name
    counts: dict[str, str] = field(default_factory=dict)  # name -> column that is neither null nor ''
    totals: dict[str, str] = field(default_factory=dict)  # name -> column that is summed under that name
    rows: str | None = None
    ratios: dict[str, tuple[str, str]] = field(default_factory=dict)  # name -> over, under (expressions in sums)
    remarks: dict[str, tuple[str, str]] = field(default_factory=dict)  # name -> label, text
    between: str = "\n"  # what stands between joined remarks


def joined_remarks(label: Column, text: Column, order: Column, between: str = "\n") -> Column:
    """One row's own text; of several, ``label: text`` in order, or '' where the first text is empty.

    The result holds all texts of its group in one cell, which is what is asked for.
    """
    rows = F.array_sort(F.collect_list(F.struct(order.alias("k"), label.alias("label"), text.alias("text"))))
    named = F.filter(rows, lambda r: r["text"].isNotNull() & r["label"].isNotNull())
    lines = F.array_join(F.transform(named, lambda r: F.concat(r["label"], F.lit(": "), r["text"])), between)
    first = F.try_element_at(F.filter(rows, lambda r: r["text"].isNotNull()), F.lit(1))["text"]
    return F.when(F.count("*") > 1, F.when(F.coalesce(first, F.lit("")) == "", "").otherwise(lines)).otherwise(first)


def roll_up(df: DataFrame, level: Level, order: str | None = None) -> DataFrame:
    """Group ``df`` by the level's keys.

    Numbers are summed up in hash maps.  Extremes of texts and joined remarks would have whole
    rows sorted for that, so where there are many numbers these are grouped apart, beside their
    keys alone.  The parts meet by the keys, a row a group.
    """
    texts = [(c, how) for names, how in ((level.least, F.min), (level.greatest, F.max)) for c in names if isinstance(df.schema[c].dataType, StringType)]
    numbers: list[Column] = []
    numbers += [F.min(c).alias(c) for c in level.least if (c, F.min) not in texts]
    numbers += [F.max(c).alias(c) for c in level.greatest if (c, F.max) not in texts]
    numbers += [F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(name) for name, c in level.counts.items()]
    numbers += [F.count("*").alias(level.rows)] if level.rows else []
    place = F.struct(*[F.col(c) for c in order.split(",")]) if order else None
    remarks = [joined_remarks(F.col(a), F.col(b), F.col(a) if place is None else place, level.between).alias(name) for name, (a, b) in level.remarks.items()]
    numbers += [F.sum(c).alias(name) for name, c in level.totals.items()]
    numbers += [F.sum(c).alias(c) for c in level.sums]
    numbers += [F.avg(c).alias(c) for c in level.means]
    numbers += [F.avg(c).alias(name) for name, c in level.averages.items()]
    numbers += [guarded_ratio(F.sum(F.expr(over)), F.sum(F.expr(under))).alias(name) for name, (over, under) in level.ratios.items()]
    ends = [how(c).alias(c) for c, how in texts]
    names = [*level.keys, *level.least, *level.greatest, *level.counts, *([level.rows] if level.rows else []), *level.remarks, *level.totals, *level.sums, *level.means, *level.averages, *level.ratios]
    if not (ends or remarks) or len(numbers) < WIDE:
        return df.groupBy(*level.keys).agg(*ends, *numbers, *remarks).select(*names)
    out = df.groupBy(*level.keys).agg(*numbers)
    if ends:
        out = _beside(out, df.groupBy(*level.keys).agg(*ends), level.keys)
    if remarks:
        out = _beside(out, df.groupBy(*level.keys).agg(*remarks), level.keys)
    return out.select(*names)


def _beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Columns of two frames with the same groups, a null key among them."""
    own = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(own, same).drop(*[f"__{k}" for k in keys])


def _recovery(oil: str, gas: str) -> dict[str, tuple[str, str]]:
    """Recovery factors: what is sold, and sold with what is left, over the volumes in place."""
    out = {"rf_oil": ("cprd_sls_oil", oil), "rf_gas": ("cprd_sls_gn", gas)}
    for kind in ("rec", "res"):
        out |= {f"urf_{kind}_oil": (f"cprd_sls_oil + {kind}_oil", oil), f"urf_{kind}_gas": (f"cprd_sls_gn + {kind}_gn", gas)}
    return out


#: Columns that say the same for all rows of a work area, and of a field.
AREA_FACTS = ("report_date", "report_status", "wk_id", "wk_name", "wk_lat", "wk_long", "wk_area_ori", "wk_area_latest", "wk_subgroup", "psc_eff_start", "psc_eff_end", "operator_group", "operator_name", "onstream_year", "onstream_actual", "project_level", "prod_stage")
FIELD_FACTS = ("basin86_id", "basin86", "basin128_id", "basin128", "prov_id", "province", "field_name", "field_lat", "field_long", "field_area", "is_unitization")
SERIES_AREA_FACTS = ("report_date", "report_status", "wk_name", "wk_lat", "wk_long", "wk_area", "wk_subgroup", "psc_eff_start", "psc_eff_end", "operator_group", "operator_name", "prod_stage", "onstream_year", "onstream_actual")
SERIES_FIELD_FACTS = ("basin86_id", "basin128", "province", "field_name", "field_lat", "field_long")
#: Flags that are counted, and the names of the counts.
ACTIVE = {"project_active_count": "project_isactive", "groovy_count": "groovy_isactive", "fusion_count": "fusion_isactive"}


def _without(columns: tuple[str, ...], keys: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(c for c in columns if c not in keys)


def resource_levels() -> tuple[Level, Level, Level]:
    """Field, work area and nation of the whole snapshot schema: all measures, counts, factors and remarks."""
    volumes = tuple(c for c in SNAPSHOT_SUMS if c not in ("prj_ioip", "prj_igip"))
    keys = ("report_year", "wk_id", "field_id", "project_stage", "project_class", "uncert_level")
    field_ = Level(
        keys,
        least=_without((*AREA_FACTS, *FIELD_FACTS), keys),
        greatest=("is_offshore", "is_discovered"),
        sums=volumes,
        counts={"pod_count": "pod_name"},
        totals={"ioip": "prj_ioip", "igip": "prj_igip"} | ACTIVE,
        rows="project_count",
        ratios=_recovery("prj_ioip", "prj_igip"),
        remarks={"field_remarks": ("project_name", "project_remarks"), "field_vol_remarks": ("project_name", "vol_remarks")},
    )
    keys = ("report_year", "wk_name", "project_stage", "project_class", "uncert_level")
    counts = ("pod_count", "project_count", *ACTIVE)
    area = Level(
        keys,
        least=_without(AREA_FACTS, keys),
        greatest=("is_offshore", "is_discovered"),
        sums=(*volumes, "ioip", "igip", *counts),
        totals={"unitisasi_count": "is_unitization"},
        rows="field_count",
        ratios=_recovery("ioip", "igip"),
        remarks={"wa_remarks": ("field_name", "field_remarks"), "wa_vol_remarks": ("field_name", "field_vol_remarks")},
        between="\n\n",
    )
    nation = Level(
        ("report_year", "project_stage", "project_class", "uncert_level"),
        least=("report_status",),
        greatest=("is_discovered",),
        sums=(*volumes, "ioip", "igip", *counts, "field_count", "unitisasi_count"),
        counts={"wa_count": "wk_id"},
    )
    return field_, area, nation


def forecast_levels() -> tuple[Level, Level, Level]:
    """Field, work area and nation of the whole series schema; heating values are averages of averages."""
    keys = ("report_year", "wk_id", "field_id", "project_class", "project_level", "year")
    own = tuple(dict.fromkeys(SERIES_SUMS))
    field_ = Level(keys, least=_without((*SERIES_AREA_FACTS, *SERIES_FIELD_FACTS), keys), greatest=("is_offshore",), sums=own, totals={"active_project_count": "project_isactive"}, averages={"ghv_avg": "ghv"}, rows="project_count")
    counts = ("project_count", "active_project_count")
    area = Level(("report_year", "wk_id", "project_class", "project_level", "year"), least=SERIES_AREA_FACTS, greatest=("is_offshore",), sums=(*own, *counts), means=("ghv_avg",), rows="field_count")
    nation = Level(("report_year", "project_class", "project_level", "year"), least=("report_status", "prod_stage"), sums=(*own, *counts, "field_count"), means=("ghv_avg",), rows="wa_count")
    return field_, area, nation


def resources(df: DataFrame, up_to: int = 3) -> list[DataFrame]:
    """Field, work area and national resources of snapshot rows, each from the one below it."""
    orders = ("project_name,project_id", "field_name,field_id", None)
    out: list[DataFrame] = []
    for level, order in list(zip(resource_levels(), orders))[:up_to]:
        df = roll_up(df, level, order)
        out.append(df)
    return out


def forecasts(df: DataFrame, up_to: int = 3) -> list[DataFrame]:
    """Field, work area and national series, each from the one below it."""
    return stack(df, forecast_levels()[:up_to])


def snapshot_levels(sums: tuple[str, ...]) -> tuple[Level, Level, Level]:
    """Field, work area and nation of a snapshot; a work area is known by its name."""
    field_ = Level(("report_year", "wk_id", "field_id", "project_stage", "project_class", "uncert_level"), ("wk_name", "field_name"), ("is_discovered",), sums, counts={"pod_count": "pod_name"}, rows="project_count")
    area = Level(("report_year", "wk_name", "project_stage", "project_class", "uncert_level"), (), ("is_discovered",), (*sums, "project_count"), rows="field_count")
    nation = Level(("report_year", "project_stage", "project_class", "uncert_level"), (), ("is_discovered",), (*sums, "project_count", "field_count"), rows="wk_count")
    return field_, area, nation


def series_levels(sums: tuple[str, ...]) -> tuple[Level, Level, Level]:
    """Field, work area and nation of a yearly series; a work area is known by its id, and heating values are averages of averages."""
    field_ = Level(("report_year", "wk_id", "field_id", "project_class", "project_level", "year"), ("field_name",), (), sums, ("ghv",), rows="project_count")
    area = Level(("report_year", "wk_id", "project_class", "project_level", "year"), (), (), (*sums, "project_count"), ("ghv",), rows="field_count")
    nation = Level(("report_year", "project_class", "project_level", "year"), (), (), (*sums, "project_count", "field_count"), ("ghv",), rows="wk_count")
    return field_, area, nation


def stack(df: DataFrame, levels: tuple[Level, ...]) -> list[DataFrame]:
    """Each level from the one below it."""
    out = []
    for level in levels:
        df = roll_up(df, level)
        out.append(df)
    return out
