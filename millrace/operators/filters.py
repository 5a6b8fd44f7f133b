"""Filters of dashboards: sentinels, periods, retention, search over lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Choice that stands for no restriction.
ALL = "전체"


def equals_or_all(df: DataFrame, column: str, choice: str, everything: str = ALL) -> DataFrame:
    """Rows whose column has the chosen value; all rows for the sentinel."""
    return df if choice == everything else df.where(F.col(column) == choice)


def trailing_days(df: DataFrame, column: str, day: str, n: int) -> DataFrame:
    """Rows of the n days that end with `day`, as a range that reaches the scan."""
    last = F.to_date(F.lit(day))
    return df.where((F.col(column) >= F.date_sub(last, n - 1)) & (F.col(column) < F.date_add(last, 1)))


def around(df: DataFrame, column: str, day: str, days: int) -> DataFrame:
    """Rows within `days` days of a day, on either side."""
    return df.where((F.col(column) >= F.date_sub(F.lit(day).cast("date"), days)) & (F.col(column) < F.date_add(F.lit(day).cast("date"), days + 1)))


def last_days_before(df: DataFrame, column: str, day: str, n: int) -> DataFrame:
    """Of a frame with one row per date: the last n rows before `day`, oldest first."""
    return df.where(F.col(column) < F.to_date(F.lit(day))).orderBy(F.desc(column)).limit(n).orderBy(column)


def retained(df: DataFrame, column: str, day: str, keep_days: int) -> DataFrame:
    """Rows not older than `keep_days`; rows whose time can't be read stay."""
    at = F.try_to_timestamp(F.col(column).cast("string"))
    return df.where(at.isNull() | (at >= F.date_sub(F.to_date(F.lit(day)), keep_days).cast("timestamp")))


def has_any_tag(tags: Column, wanted: list[str]) -> Column:
    """Whether some tag is wanted, whatever the case."""
    return F.arrays_overlap(F.transform(tags, F.lower), F.array(*(F.lit(t.lower()) for t in wanted)))


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page `number` (from 1) of the ordered rows."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order, unlike dropDuplicates, which keeps any."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("keep_first_rank", rank).where("keep_first_rank = 1").drop("keep_first_rank")
