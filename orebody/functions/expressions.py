"""Scalar operators as column expressions; nothing here leaves the JVM but ``ellipsoid_km``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import EMPTY_REMARKS, PROBLEM_HEADS, PROBLEMS, UNIT_NAMES

EARTH_KM = 6371.0


def guarded_ratio(over: Column, under: Column) -> Column:
    """over / under where under is positive, else 0."""
    return F.when(under > 0, over / under).otherwise(0.0)


def has_remark(text: Column) -> Column:
    return text.isNotNull() & ~F.lower(F.trim(text)).isin(*EMPTY_REMARKS)


def contains_text(column: Column, text: str | None) -> Column:
    """Case-insensitive substring test; wildcards in the text stand for themselves; no text is no filter."""
    if not text:
        return F.lit(True)
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def days_in_year(year: Column) -> Column:
    """By the rule year % 4, as the source counts them."""
    return F.when(year % 4 == 0, 366).otherwise(365)


def convert_volume(volume: Column, source: str, target: str, year: Column) -> Column:
    """Yearly volumes to daily rates; a pair that is not known leaves the volume as it is."""
    factors = {("MSTB", "BOPD"): 1000.0, ("BSCF", "MMSCFD"): 1000.0, ("MSTBY", "BOPD"): 1.0, ("BSCFY", "MMSCFD"): 1.0}
    factor = factors.get((source.upper(), target.upper()))
    return volume if factor is None else volume * F.lit(factor) / days_in_year(year)


def barrels_equivalent(oil: Column, gas: Column) -> Column:
    """MSTB plus BSCF at 5.615 to the barrel."""
    return oil + gas / F.lit(5.615) * 1000


def is_forecast(year: Column, hist_year: Column, report_year: Column) -> Column:
    """Whether a year lies behind the last one with history, or behind the report's; an unknown one says nothing."""
    return F.coalesce(year > hist_year, F.lit(False)) | F.coalesce(year > report_year, F.lit(False))


def in_years(date: Column, years: list[int] | tuple[int, ...]) -> Column:
    """Whether a date or timestamp falls in one of the years, as ranges that reach the scan."""
    out = F.lit(False)
    for y in years:
        out = out | ((date >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (date < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz")))
    return out


def shown_value(value: Column, unit: str) -> Column:
    """``1,234.50 MSTB (Thousand Stock Tank Barrels)``; ``N/A`` for no value."""
    return F.when(value.isNull(), "N/A").otherwise(F.concat(F.format_number(value, 2), F.lit(f" {unit} ({UNIT_NAMES.get(unit, unit)})")))


def shortened(text: Column, limit: int = 200) -> Column:
    """The text, or its first ``limit`` characters and three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def haversine_km(lat_1: Column, long_1: Column, lat_2: Column, long_2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat_2 - lat_1) / 2), 2) + F.cos(F.radians(lat_1)) * F.cos(F.radians(lat_2)) * F.pow(F.sin(F.radians(long_2 - long_1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def vincenty_km(lat_1: np.ndarray, long_1: np.ndarray, lat_2: np.ndarray, long_2: np.ndarray) -> np.ndarray:
    """Distance on the WGS-84 ellipsoid by Vincenty's inverse formula; haversine where it does not settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    p1, l1, p2, l2 = (np.radians(np.asarray(x, float)) for x in (lat_1, long_1, lat_2, long_2))
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    turn = l2 - l1
    lam = turn.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(40):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s > 0, sin_s, 1), 0)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a > 1e-14, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a > 1e-14, cos2_a, 1), 0)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = turn + (1 - c) * f * sin_a * (s + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            moved, lam = np.abs(new - lam), new
        k = cos2_a * (a**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        fix = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        out = b * big_a * (s - fix) / 1000
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(turn / 2) ** 2
        round_earth = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
    return np.where(moved < 1e-11, out, round_earth)


@F.pandas_udf(T.DoubleType())
def ellipsoid_km(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for four in parts:
        yield pd.Series(vincenty_km(*four))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null where a norm is zero."""
    left, right = left.cast("array<double>"), right.cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(left, zero, lambda s, x: s + x * x)) * F.sqrt(F.aggregate(right, zero, lambda s, x: s + x * x))
    return F.when(norm > 0, dot / norm)


def check_digit(payload: Column) -> Column:
    """Luhn check digit modulo 16 of a hexadecimal payload; null where it is not one."""
    digits = F.split(F.reverse(F.upper(payload)), "")
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))

    def weighed(value: Column, place: Column) -> Column:
        twice = value * 2
        return F.when(place % 2 == 0, F.when(twice >= 16, twice - 15).otherwise(twice)).otherwise(value)

    total = F.aggregate(F.transform(values, weighed), F.lit(0), lambda s, x: s + x)
    digit = F.hex(((F.lit(16) - total % 16) % 16).cast("long"))
    return F.when(payload.rlike("^[0-9A-Fa-f]+$"), digit)


def _compact(value: Column) -> Column:
    return F.replace(F.upper(F.trim(value)), F.lit("-"))


def _distinct_digits(text: Column) -> Column:
    return F.size(F.array_distinct(F.split(text, ""))) == F.length(text)


def valid_field_id(field_id: Column) -> Column:
    """Whether F-GG-SSSS-C, with or without dashes, has four different decimal digits and the check digit of grid and suffix."""
    raw = _compact(field_id)
    sound = raw.rlike("^F[0-9A-F]{2}[0-9]{4}[0-9A-F]$") & _distinct_digits(F.substring(raw, 4, 4)) & (check_digit(F.substring(raw, 2, 6)) == F.substring(raw, 8, 1))
    return F.coalesce(sound, F.lit(False))


def valid_project_id(project_id: Column) -> Column:
    """Whether P-FFFFFFF-NN holds a valid field id and a number from 01 to 99."""
    raw = _compact(project_id)
    sound = raw.rlike("^P[0-9A-F]{7}[0-9]{2}$") & valid_field_id(F.concat(F.lit("F"), F.substring(raw, 2, 7))) & (F.substring(raw, 9, 2) != "00")
    return F.coalesce(sound, F.lit(False))


def valid_zone_id(zone_id: Column) -> Column:
    """Whether Z-FFFFFFF-SSS-C holds a valid field id, three different digits and the check digit of both."""
    raw = _compact(zone_id)
    sound = raw.rlike("^Z[0-9A-F]{7}[0-9]{3}[0-9A-F]$") & valid_field_id(F.concat(F.lit("F"), F.substring(raw, 2, 7)))
    sound = sound & _distinct_digits(F.substring(raw, 9, 3)) & (check_digit(F.substring(raw, 2, 10)) == F.substring(raw, 12, 1))
    return F.coalesce(sound, F.lit(False))


def problem_codes(text: Column) -> Column:
    """Known problem codes of a text, each once: those behind a head word, by the order of heads, then bare ones.

    One scan finds every number with the word before it and what clings to its end.
    """
    head, number = r"(?:\b(problem cluster|\p{L}+)[:\s]+)?", r"(\d(?:\.\d+){1,2})(\w?)"
    found = F.regexp_extract_all(text, F.lit(rf"(?i){head}(?<![\w]){number}"), F.lit(0))
    # a match is taken apart by itself, which is short
    parts = F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, rf"(?i)^{head}{number}$", k).alias(n) for k, n in ((1, "word"), (2, "code"), (3, "tail"))]))
    heads = F.array(*[F.lit(h) for h in PROBLEM_HEADS])
    known = F.array(*[F.lit(c) for c in PROBLEMS])
    rows = F.transform(parts, lambda r, k: F.struct(F.array_position(heads, F.lower(r["word"])).alias("head"), k.alias("at"), r["code"].alias("code"), r["tail"].alias("tail")))
    rows = F.filter(rows, lambda r: F.array_contains(known, r["code"]) & ((r["head"] > 0) | (r["tail"] == "")))
    ranked = F.transform(rows, lambda r: F.struct(F.when(r["head"] > 0, r["head"]).otherwise(len(PROBLEM_HEADS) + 1).alias("rank"), r["at"], r["code"]))
    found = F.array_distinct(F.transform(F.array_sort(ranked), lambda r: r["code"]))
    return F.coalesce(found, F.array().cast("array<string>"))


def match_confidence(name: Column, term: str) -> Column:
    """1.0 for the name itself, 0.9 for its beginning, 0.8 inside it, else 0.6; case aside."""
    low, term = F.lower(name), term.lower()
    return F.when(low == term, 1.0).when(low.startswith(term), 0.9).when(low.contains(term), 0.8).otherwise(0.6)
