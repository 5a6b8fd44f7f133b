"""Coercion and ordering conventions of operational views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(x: Column) -> Column:
    """Whole number; null, empty and malformed values count as 0."""
    return F.coalesce(x.try_cast("long"), F.lit(0))


def safe_double(x: Column) -> Column:
    """Number; null, empty and malformed values count as 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def money(x: Column) -> Column:
    """Exact cents: sums of it do not depend on the order of rows."""
    return x.cast("decimal(18,2)")


def ratio_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole with a whole of at least 1, rounded."""
    return F.round(part * F.lit(100.0) / F.greatest(whole, F.lit(1)), digits)


def growth_pct(now: Column, before: Column, digits: int = 1) -> Column:
    """Change in percent; 0 where there was nothing before."""
    return F.when(F.coalesce(before, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round((now - before) * F.lit(100.0) / before, digits))


def arrow(change: Column) -> Column:
    """▲, ▼ or ─ by sign."""
    return F.when(change > 0, "▲").when(change < 0, "▼").otherwise("─")


def band(x: Column, *limits: tuple[float, str], otherwise: str) -> Column:
    """The label of the first limit that x reaches, from the highest on."""
    out = None
    for limit, label in sorted(limits, reverse=True):
        out = F.when(x >= limit, label) if out is None else out.when(x >= limit, label)
    return out.otherwise(otherwise)


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def clean_amount(x: Column) -> Column:
    """Amount of a text with separators and currency signs; 0 where nothing is left."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(x, r"[,￦₩\s]", ""), r"[^\d\-]", "").try_cast("long"), F.lit(0))


def thousands(x: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(x, 0)


def ten_thousands(x: Column) -> Column:
    """Whole ten-thousands with separators and their unit, as reports of amounts have them."""
    return F.concat(F.format_number(F.floor(x / 10000), 0), F.lit("만"))


def room_parts(x: Column) -> Column:
    """Ward, room and bed of a room number, which is filled with zeros up to six digits."""
    full = F.when(F.length(x) < 6, F.lpad(x, 6, "0")).otherwise(x)
    return F.struct(F.substring(full, 1, 2).alias("ward"), F.substring(full, 3, 2).alias("room"), F.substring(full, 5, 2).alias("bed"), F.substring(full, 1, 4).alias("room_key"))


def sex(x: Column) -> Column:
    """F or M from the usual spellings; empty for others."""
    known = F.upper(F.trim(x))
    return F.when(known.isin("F", "여", "여자", "여성", "FEMALE"), "F").when(known.isin("M", "남", "남자", "남성", "MALE"), "M").otherwise("")


def percentile_upper(values: Column, q: float) -> Column:
    """The element at index int(n q) of the sorted values, the last one at most; null for none."""
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, F.least(F.floor(F.size(values) * q).cast("int") + 1, F.size(values)))
