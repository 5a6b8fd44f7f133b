"""Top-n per group, with an "other" bucket for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_with_other(df: DataFrame, group: str, amount: str, n: int, other: str = "OTHER") -> DataFrame:
    """The n groups with the largest sums of `amount` and one row for the rest, with shares of the whole.

    Ties go to the group that sorts first. Sums are exact decimals until the last step.
    """
    sums = df.groupBy(F.col(group).alias("grp")).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("value"))
    top = sums.orderBy(F.desc("value"), "grp").limit(n)
    names = top.select(F.col("grp").alias("name"))
    rest = sums.join(F.broadcast(names), F.col("grp").eqNullSafe(F.col("name")), "left_anti")  # n names
    folded = top.unionByName(rest.agg(F.lit(other).alias("grp"), F.sum("value").alias("value")).where(F.col("value").isNotNull()))
    folded = folded.groupBy("grp").agg(F.sum("value").alias("value")).crossJoin(F.broadcast(sums.agg(F.sum("value").alias("whole"))))  # one row
    return folded.select("grp", F.col("value").cast("double").alias("value"), F.round(F.col("value").cast("double") * 100 / F.col("whole").cast("double"), 4).alias("share_pct"))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rk") -> DataFrame:
    """The first n rows of each group with their rank; partitions are cut to n rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def nearest_rank(df: DataFrame, group: str, value: str, quantiles: dict[str, float], slices: int = 1000) -> DataFrame:
    """Each group's number of rows and the values at index int(n q) of its sorted values, the last at most. Values are numbers.

    A group's range of values is cut into slices; their counts say in which slice an index falls, and only that slice is sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("times"))
    spans = counts.groupBy(F.col(group).alias("of")).agg(F.sum("times").alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    share = F.try_divide(F.col(value).cast("double") - F.col("low"), F.col("high") - F.col("low"))
    sliced = counts.join(spans, F.col(group).eqNullSafe(F.col("of"))).withColumn("slice", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * slices), F.lit(slices - 1)).cast("int"))
    before = F.sum("rows").over(Window.partitionBy("of").orderBy("slice")) - F.col("rows")
    sums = sliced.groupBy("of", "n", "slice").agg(F.sum("times").alias("rows")).withColumn("before", before)
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * q) + 1, F.col("n")).alias("at")) for name, q in quantiles.items())))
    hit = sums.select("of", "slice", "before", "rows", wanted.alias("w")).where((F.col("w.at") > F.col("before")) & (F.col("w.at") <= F.col("before") + F.col("rows")))
    hit = hit.select(F.col("of").alias("in"), F.col("slice").alias("hit_slice"), "before", "w.name", "w.at")
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("in", "name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = sliced.join(hit, F.col("of").eqNullSafe(F.col("in")) & (F.col("slice") == F.col("hit_slice"))).withColumn("upto", upto).where(F.col("upto") >= F.col("at"))
    return found.groupBy(group).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in quantiles))


def listed_first(df: DataFrame, column: str, listed: list[str], otherwise: int) -> DataFrame:
    """The values of a column with their place in a list (`otherwise` for others) and their rank by place and name."""
    place = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, v in enumerate(listed) for x in (v, i + 1))), F.trim(column)), F.lit(otherwise))
    return df.withColumn("place", place).withColumn("rk", F.row_number().over(Window.orderBy("place", F.asc_nulls_last(column))))
