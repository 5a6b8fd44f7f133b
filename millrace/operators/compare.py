"""Comparisons of periods: deltas, growth, anomalies, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.coerce import arrow, growth_pct


def two_periods(df: DataFrame, group: str, amount: Column, now: Column, before: Column) -> DataFrame:
    """Sums of each group in two periods, zero where a group has no rows in one, from a single pass."""
    sums = df.where(now | before).groupBy(F.col(group).alias("grp")).agg(
        F.coalesce(F.sum(F.when(now, amount)), F.lit(0)).alias("now_value"), F.coalesce(F.sum(F.when(before, amount)), F.lit(0)).alias("before_value"))
    change = F.col("now_value") - F.col("before_value")
    return sums.withColumn("change", change).withColumn("growth_pct", growth_pct(F.col("now_value").cast("double"), F.col("before_value").cast("double"))).withColumn("direction", arrow(change))


def anomalies(compared: DataFrame, least_before: float, least_pct: float, n: int, inclusive: bool = False) -> DataFrame:
    """The n groups that changed most, of those that were large enough and changed by `least_pct` or more, either way."""
    large = F.col("before_value") >= least_before if inclusive else F.col("before_value") > least_before
    return compared.where(large & (F.abs("growth_pct") >= least_pct)).orderBy(F.desc(F.abs("growth_pct")), "grp").limit(n)


def with_share(df: DataFrame, amount: str, name: str = "share_pct", by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Each row's share of the whole, or of its group, in percent; null where the whole is 0."""
    share = lambda whole: F.round(F.try_divide(F.col(amount).cast("double") * 100, whole.cast("double")), digits)
    if by:
        return df.withColumn(name, share(F.sum(amount).over(Window.partitionBy(*by))))
    whole = F.broadcast(df.agg(F.sum(amount).alias("share_whole")))  # one row
    return df.crossJoin(whole).withColumn(name, share(F.col("share_whole"))).drop("share_whole")


def dependency(df: DataFrame, amount: str, risk: float = 60, caution: float = 40) -> DataFrame:
    """The largest group, its share of the whole, and what that share means."""
    shared = with_share(df, amount)
    top = shared.orderBy(F.desc(amount), "grp").limit(1)
    level = F.when(F.col("share_pct") >= risk, "risk").when(F.col("share_pct") >= caution, "caution").otherwise("ok")
    return top.withColumn("level", level)


def lagged(df: DataFrame, order: str, amount: str, by: list[str] | None = None) -> DataFrame:
    """Each row with the previous one's amount, the change and its direction."""
    before = F.lag(amount).over(Window.partitionBy(*(by or [])).orderBy(order))
    out = df.withColumn("previous", before)
    return out.withColumn("change", F.col(amount) - F.coalesce("previous", F.col(amount))).withColumn("direction", arrow(F.col("change")))


def moving_mean(df: DataFrame, order: list[Column], amount: str, rows: int, by: list[str], digits: int = 4) -> DataFrame:
    """Mean of the last `rows` rows of each group."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("moving_mean", F.round(F.avg(amount).over(frame), digits))
