"""Grouping sets, totals and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_total(df: DataFrame, keys: list[str], sums: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """Sums by the keys, and for each value of the first key a row in which the others say `total`."""
    grouped = df.rollup(*keys).agg(F.grouping_id().alias("level"), *(v.alias(k) for k, v in sums.items()))
    kept = grouped.where(F.col("level").isin(0, (1 << (len(keys) - 1)) - 1))
    labels = [F.col(keys[0])] + [F.when(F.col("level") > 0, F.lit(total)).otherwise(F.col(k)).alias(k) for k in keys[1:]]
    return kept.select(*labels, *sums)


def cube(df: DataFrame, keys: list[str], sums: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """Sums for every combination of keys and totals over them."""
    grouped = df.cube(*keys).agg(*(F.grouping(k).alias(f"all_{k}") for k in keys), *(v.alias(k) for k, v in sums.items()))
    return grouped.select(*(F.when(F.col(f"all_{k}") == 1, F.lit(total)).otherwise(F.col(k)).alias(k) for k in keys), *sums)


def pivot(df: DataFrame, row: str, column: str, values: list[str], amount: Column) -> DataFrame:
    """One column for each of the given values; 0 where there are no rows. The values are stated, so no pass looks for them."""
    sums = df.groupBy(row).pivot(column, values).agg(amount)
    return sums.select(row, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values))


def last_wins(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """The value of each key's last row in a stated order."""
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in `bins` steps from least to largest; the largest value itself is in a bin of its own, number `bins`."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / bins)
    at = F.floor((F.col(value) - F.col("lo")) / step).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
