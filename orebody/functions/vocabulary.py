"""Closed vocabularies and the column grammar ``{prefix}_{substance}[_risked]``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Levels, classes and stages as the data spells them.
LOW, MIDDLE, HIGH = "1. Low Value", "2. Middle Value", "3. High Value"
CLASSES = {
    "reserves": "1. Reserves & GRR",
    "cadangan": "1. Reserves & GRR",
    "grr": "1. Reserves & GRR",
    "contingent": "2. Contingent Resources",
    "kontingen": "2. Contingent Resources",
    "prospective": "3. Prospective Resources",
    "prospektif": "3. Prospective Resources",
    "abandoned": "4. Abandoned",
}
#: Words of a question that ask for a stage, as the derived column spells it.
STAGES = {
    "Exploration": ("eksplorasi", "exploration", "explorasi"),
    "Exploitation": ("eksploitasi", "exploitation", "pengembangan", "development"),
}
#: Long names of units.
UNIT_NAMES = {"MSTB": "Thousand Stock Tank Barrels", "BSCF": "Billion Standard Cubic Feet", "MBOE": "Thousand Barrels Oil Equivalent"}
SUBSTANCES = ("oil", "con", "ga", "gn", "oc", "an")
#: Texts that stand for no remark.
EMPTY_REMARKS = ("", "-", "null", "none", "n/a", "na")


def family(prefix: str, suffix: str = "") -> list[str]:
    """The six columns of a measure, one for each substance."""
    return [f"{prefix}_{s}{suffix}" for s in SUBSTANCES]


#: Measures of a snapshot that add up over projects.
SNAPSHOT_SUMS = [
    *family("rec"),
    *family("rec", "_risked"),
    *family("res"),
    "prj_ioip",
    "prj_igip",
    *family("eur_rec"),
    *family("eur_res"),
    *family("rate_grs"),
    *family("rate_sls"),
    *family("cprd_grs"),
    *family("cprd_sls"),
    *[c for kind in ("um", "ppa", "wi", "cio", "uc") for c in family(f"dcpy_{kind}")],
    "ghv_avg",
]
#: Measures of a forecast year that add up over projects.
SERIES_SUMS = [
    *family("tpf"),
    *family("tpf_risked"),
    *[c for kind in ("slf", "spf", "crf", "prf", "ciof", "lossf") for c in family(kind)],
    *family("cprd_grs"),
    *family("cprd_sls"),
    *family("rate"),
]

#: Columns of the two base tables that are no measures.
SNAPSHOT_INTEGERS = "id report_year is_offshore is_discovered is_ltp is_pse_approved is_pod_approved is_report_accepted is_unitization project_eol project_isactive groovy_isactive fusion_isactive onstream_year".split()
SNAPSHOT_TEXTS = (
    "report_date report_status wk_id wk_name psc_eff_start psc_eff_end wk_subgroup operator_group wk_area_perwakilan_skkmigas wk_regionisasi_ngi operator_name basin86_id basin86 basin128_id basin128 prov_id province "
    "field_id field_name field_name_previous pod_letter_num pod_name pod_date project_id project_name project_name_previous project_stage onstream_actual project_remarks "
    "project_class project_level project_level_previous prod_stage uncert_level vol_remarks"
).split()
SNAPSHOT_PLACES = "wk_lat wk_long wk_area wk_area_ori wk_area_latest field_lat field_long field_area".split()
SERIES_INTEGERS = "id report_year is_offshore project_isactive onstream_year year hist_year".split()
SERIES_TEXTS = (
    "report_date basin86_id basin128 province operator_group report_status wk_id wk_name wk_regionisasi_ngi wk_area_perwakilan_skkmigas psc_eff_start psc_eff_end wk_subgroup operator_name field_id field_name project_id "
    "project_name project_remarks vol_remarks frcast_remarks pod_letter_num pod_name onstream_actual project_class project_level prod_stage"
).split()
#: Text in the source; read as numbers here, so that a least value is not one of spelling.
SERIES_PLACES = "wk_lat wk_long field_lat field_long".split()


def _struct(integers: list[str], texts: list[str], doubles: list[str], reals: list[str]) -> T.StructType:
    kinds = ((integers, T.IntegerType()), (texts, T.StringType()), (doubles, T.DoubleType()), (reals, T.FloatType()))
    return T.StructType([T.StructField(c, kind) for names, kind in kinds for c in dict.fromkeys(names)])


def snapshot_schema() -> T.StructType:
    extra = ["rec_mboe", "rec_mboe_risked", "gcf_srock", "gcf_res", "gcf_ts", "gcf_dyn", "gcf_total", "pd", "rf_oil", "rf_gas", "urf_rec_oil", "urf_rec_gas", "urf_res_oil", "urf_res_gas", *family("dcpy_gtr")]
    return _struct(SNAPSHOT_INTEGERS, SNAPSHOT_TEXTS, SNAPSHOT_PLACES, [*SNAPSHOT_SUMS, *extra])


def series_schema() -> T.StructType:
    return _struct(SERIES_INTEGERS, SERIES_TEXTS, SERIES_PLACES, ["wk_area", *SERIES_SUMS, "ghv"])


@dataclass(frozen=True)
class Uncertainty:
    """A level as stored, or the difference of two of them."""

    level: str
    less: str | None = None
    reserves_only: bool = False


def uncertainty(name: str) -> Uncertainty:
    """``1P``..``3U``, ``probable`` (2P - 1P) or ``possible`` (3P - 2P); anything else is the middle level.

    Levels are cumulative: 3P is one stored level and never a sum of levels.
    """
    name = name.strip().upper()
    levels = {"1": LOW, "2": MIDDLE, "3": HIGH}
    if name == "PROBABLE":
        return Uncertainty(MIDDLE, LOW, True)
    if name == "POSSIBLE":
        return Uncertainty(HIGH, MIDDLE, True)
    if len(name) == 2 and name[0] in levels and name[1] in "PRCU":
        return Uncertainty(levels[name[0]])
    return Uncertainty({"LOW": LOW, "PROVEN": LOW, "HIGH": HIGH}.get(name, MIDDLE))


def volume_columns(kind: str, substance: str | None = None, risked: bool = False) -> list[str]:
    """Columns of a kind of volume (``res`` or ``rec``), for ``oil``, ``gas`` or both."""
    names = {"oil": ("oil", "con"), "gas": ("ga", "gn"), None: ("oc", "an")}[substance]
    return [f"{kind}_{s}{'_risked' if risked and kind == 'rec' else ''}" for s in names]


#: Codes of the problem classification and their names.
PROBLEMS = {
    "1.1.1": "Subsurface Uncertainty",
    "1.1.2": "Data Availability",
    "1.1.3": "Recovery Technology",
    "1.1.4": "Well Performance",
    "1.2.1": "Well Interventions",
    "1.2.2": "Production Facilities",
    "1.2.3": "Flow Assurance",
    "2.1": "Marginal",
    "2.2": "Uneconomic",
    "2.3": "Portfolio Priority",
    "2.4": "Market Availability",
    "2.5": "Transportation Facilities",
    "3.1.1": "Regulations",
    "3.1.2": "AMDAL",
    "3.1.3": "Permit",
    "3.1.4": "Geopolitics",
    "3.2.1": "PSC",
    "3.2.2": "Sales Agreement",
    "4.1": "Land Acquisition",
    "4.2": "Social Problems",
    "4.3": "Local Customs",
}

#: Words that announce a code, in the order in which codes are reported.
PROBLEM_HEADS = ("problem cluster", "kendala", "cluster", "masalah")
#: Categories of codes by how the codes begin.
PROBLEM_CATEGORIES = {
    "1.1": "Technical > Subsurface",
    "1.2": "Technical > Non Subsurface",
    "2": "Economics",
    "3.1": "Legal > Law and Regulations",
    "3.2": "Legal > T&C Contracts",
    "4": "Social and Environment",
}
#: Words by which a code is searched.
PROBLEM_WORDS = {
    "1.1.1": ("fluid contact", "reservoir properties", "carbonate", "uncertainty", "tidak terdefinisi"),
    "1.1.2": ("data", "tidak tersedia", "seismik", "well test", "core"),
    "1.1.3": ("teknologi", "tidak tersedia", "EOR", "surfactant", "horizontal well"),
    "1.1.4": ("well performance", "laju alir", "permeabilitas", "skin factor"),
    "1.2.1": ("workover", "well service", "acidizing", "hydraulic fracturing", "skin"),
    "1.2.2": ("fasilitas", "facility", "treatment", "CO2", "production facilities"),
    "1.2.3": ("flow assurance", "hydrate", "wax", "heater", "H2S", "solvent"),
    "2.1": ("marginal", "fiscal term", "perpajakan", "ekonomi", "tidak menarik"),
    "2.2": ("uneconomic", "NPV", "negatif", "tidak ekonomis", "investasi besar"),
    "2.3": ("portfolio", "prioritas", "pinjaman", "lender", "investasi"),
    "2.4": ("market", "buyer", "tidak tersedia", "penyerapan"),
    "2.5": ("transportasi", "transmisi", "pipeline", "lokasi", "jauh"),
    "3.1.1": ("regulasi", "aturan", "konservasi", "tumpang tindih", "pemerintah"),
    "3.1.2": ("AMDAL", "izin lingkungan", "persetujuan"),
    "3.1.3": ("permit", "izin", "beroperasi", "latihan militer"),
    "3.1.4": ("geopolitik", "perbatasan", "perselisihan", "negara"),
    "3.2.1": ("PSC", "batasan kontrak", "durasi", "kontrak"),
    "3.2.2": ("sales agreement", "ketidaksepakatan", "T&C", "kontrak jual beli"),
    "4.1": ("land acquisition", "pengadaan lahan", "penolakan", "harga tanah"),
    "4.2": ("social", "masyarakat", "konflik", "penolakan", "gejolak sosial"),
    "4.3": ("customs", "adat", "tanah adat", "kepala adat", "persetujuan adat"),
}


def problem_category(code: str) -> str:
    return next(name for start, name in PROBLEM_CATEGORIES.items() if code == start or code.startswith(start + "."))
