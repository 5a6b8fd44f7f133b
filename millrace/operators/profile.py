"""What a result's columns are, and which chart suits it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.masking import kind_of

#: Column names by role, tried in this order.
ROLES = (("date", r"date|day$|_dt$|일자|날짜"), ("time", r"time|_tm$|시간"), ("count", r"count|cnt|^n_?$|sum|total|건수|합계|금액|amount"), ("age", r"^age|나이|연령"), ("category", r"type|status|flag|name|segment|priority|lang|source|구분|명$"))


def value_shares(df: DataFrame) -> DataFrame:
    """One row a column: rows with a value, and the shares of them that look like a date, a time and a number, and its distinct values."""
    def share(c: Column, ok: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(ok), F.count(c)), F.lit(0.0))

    aggregates = []
    for name in df.columns:
        c = F.col(f"`{name}`").cast("string")
        clock = c.rlike(r"^\d{3,4}$") & (c.try_cast("int") < 2400)
        aggregates.append(F.struct(
            F.lit(name).alias("name"), F.count(c).alias("n"), share(c, c.rlike(r"^(19|20)\d{6}$|^\d{4}-\d{2}(-\d{2})?|^(19|20)\d{4}$")).alias("dates"),
            share(c, clock).alias("times"), share(c, F.replace(c, F.lit(","), F.lit("")).try_cast("double").isNotNull()).alias("numbers"), F.approx_count_distinct(c, 0.02).alias("values")))
    return df.agg(F.array(*aggregates).alias("c")).select(F.inline("c"))


def roles(df: DataFrame) -> dict[str, str]:
    """Each column's role, by name, by type, or by what 70 percent of its values look like. One pass over all rows."""
    out = {}
    unknown = []
    for f in df.schema.fields:
        named = next((role for role, pattern in ROLES if re.search(pattern, f.name, re.I)), None)
        if named and not (named == "count" and not isinstance(f.dataType, T.NumericType)):
            out[f.name] = named
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "date"
        else:
            unknown.append(f.name)
    if unknown:
        for r in value_shares(df.select(*(F.col(f"`{c}`") for c in unknown))).collect():  # a row for each column
            out[r.name] = "date" if r.dates >= 0.7 and r.n else "time" if r.times >= 0.7 and r.n else "numeric" if r.numbers >= 0.8 and r["values"] > 20 else "category" if r["values"] <= 20 else "text"
    return {c: out[c] for c in df.columns}


def chart(df: DataFrame, found: dict[str, str] | None = None) -> str:
    """line over dates, pie up to 8 categories, bar up to 20, barh up to 50, else table."""
    found = found or roles(df)
    if any(r == "date" for r in found.values()):
        return "line"
    names = [c for c, r in found.items() if r in ("category", "text") and not kind_of(c)]
    if not names:
        return "table"
    values = df.agg(F.count_distinct(F.col(f"`{names[0]}`")).alias("n")).first().n
    return next((kind for most, kind in ((8, "pie"), (20, "bar"), (50, "barh")) if values <= most), "table")


def summarise(df: DataFrame) -> DataFrame:
    """One row per numeric column: sum, mean, least and largest, of one pass."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x")) for c in numeric))))
    return long.groupBy("name").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))


def intent(question: str, rows: int, found: dict[str, str]) -> str:
    """KPI for up to three rows with a count, LIST for raw rows, AGG otherwise."""
    if rows <= 3 and any(r in ("count", "numeric") for r in found.values()):
        return "KPI"
    if re.search(r"list|목록|명단|who|which", question, re.I) or not any(r in ("count", "numeric") for r in found.values()):
        return "LIST"
    return "AGG"


#: Sketches' sizes: log2 of HLL's registers (about 1.6 % of the distinct values), and KLL's k (about 1.3 % of the ranks).
HLL_SIZE, KLL_SIZE = 12, 200


def day_profiles(df: DataFrame, day: Column) -> DataFrame:
    """(day, name, n, numbers, least, most, values, ranks): what each column holds on each day; `values` and `ranks` are sketches that merge.

    A table of these, kept day by day, answers for any span of days without the rows.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")) for c in df.columns))
    long = df.select(day.alias("day"), F.inline(cells))
    return long.groupBy("day", "name").agg(
        F.count("text").alias("n"), F.count("x").alias("numbers"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.hll_sketch_agg("text", HLL_SIZE).alias("values"), F.kll_sketch_agg_double("x", KLL_SIZE).alias("ranks"))


def merged_profiles(days: DataFrame) -> DataFrame:
    """(name, n, numeric, least, most, distinct, low, median, high) of each column over all these days; distinct and the quantiles 0.1, 0.5, 0.9 are estimates."""
    sums = days.groupBy("name").agg(
        F.sum("n").alias("n"), F.sum("numbers").alias("numbers"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))
    at = lambda q: F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(q)))
    return sums.select("name", "n", (F.col("numbers") > 0).alias("numeric"), "least", "most", "distinct", at(0.1).alias("low"), at(0.5).alias("median"), at(0.9).alias("high"))


def grouping(profiles: DataFrame, most_values: int = 20, columns: int = 3) -> tuple[list[str], list[str]]:
    """Which columns to group by and which to add up, from merged profiles: the fewest-valued ones of 2 to `most_values` values, and numbers with more.

    Columns of personal data are neither.
    """
    rows = [r for r in profiles.orderBy("distinct", "name").collect() if not kind_of(r.name)]  # a row a column
    return [r.name for r in rows if 2 <= r.distinct <= most_values][:columns], sorted(r.name for r in rows if r.numeric and r.distinct > most_values and not re.search(r"(?i)key$|_?id$", r.name))


def smart_aggregate(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(dimension, value, measure, n, total, mean): each measure by each dimension and over all, of one pass over the rows by grouping sets."""
    sums = [x for m in measures for x in (F.count(f"`{m}`").alias(f"n {m}"), F.sum(F.col(f"`{m}`").cast("decimal(38,4)")).alias(f"total {m}"))]
    sets = df.groupingSets([[F.col(f"`{c}`")] for c in by] + [[]], *(F.col(f"`{c}`") for c in by)).agg(F.grouping_id().alias("which"), *sums)
    which = {(1 << len(by)) - 1 - (1 << (len(by) - 1 - i)): c for i, c in enumerate(by)}
    dimension = F.coalesce(*(F.when(F.col("which") == k, F.lit(c)) for k, c in which.items()), F.lit("all"))
    value = F.coalesce(*(F.when(F.col("which") == k, F.col(f"`{c}`").cast("string")) for k, c in which.items())) if by else F.lit(None).cast("string")
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"`n {m}`").alias("n"), F.col(f"`total {m}`").cast("double").alias("total")) for m in measures))
    return sets.select(dimension.alias("dimension"), value.alias("value"), F.inline(each)).withColumn("mean", F.round(F.try_divide("total", "n"), 4))
