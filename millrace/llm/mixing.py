"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is met by complete epochs of all its documents and a weighted sample for the rest: each
document draws an exponential key with its quality weight as rate, and the documents of the smallest keys are taken,
in order, until their sizes reach what the epochs leave. Documents are sorted by source and key into ranges of even numbers of rows,
whatever the weights; the ranges' sizes are prefix-summed, and only within the range in which the target is reached are documents summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, drop

#: Documents, about, in one range of keys.
RANGE_ROWS = 20_000
#: Sources, at most, whose targets are broadcast to the documents; those of more are joined.
BROADCAST_SOURCES = 10_000
#: No document is used more often than this.
MAX_EPOCHS = 2


def word_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """The share of a text's characters that are neither digits nor symbols, 0.05 at least: prose weighs more than tables and code."""
    symbols = "0123456789!#$%&()*+/<=>@[\\]^_{|}~"
    shown = F.length(F.translate(F.col(text), symbols, ""))
    return F.greatest(F.coalesce(F.try_divide(shown, F.length(text)), F.lit(0.05)), F.lit(0.05))


def _numbered(sources: DataFrame) -> DataFrame:
    """`sources` with `place`: 0, 1, ... by code point, null last. Sorted in ranges, so of any number."""
    n = sources.count()
    parts = cut(sources.repartitionByRange(max(1, -(-n // RANGE_ROWS)), F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "source-ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    out = cut(parts.withColumn("inside", inside).join(before, "part").select(*sources.columns, (F.col("before") + F.col("inside")).alias("place")), "sources")
    drop(parts)
    return out


def targets(sources: DataFrame, budget: float, weights: tuple[float, ...] = (5, 2, 1), cap: float = MAX_EPOCHS) -> DataFrame:
    """`sources` (source, size, ...) with `target`: `budget` times all sizes shared by weight, none above `cap` times its size, the excess reshared.

    Sources go by code point, null last, and take the weights in turn. Each round gives the sources that a share by weight would fill what fills them
    and shares the rest anew; only the share goes to the driver.
    """
    placed = _numbered(sources).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    full, share, total = F.lit(False), -1.0, None
    while True:
        sums = placed.agg(F.sum("size").alias("all"), F.sum(F.when(full, F.col("size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        total = budget * (sums["all"] or 0)
        if not sums["open"]:  # all are full, or there is no source
            return placed.withColumn("target", F.col("size") * float(cap))
        before, share = share, (total - cap * (sums["full"] or 0)) / sums["open"]
        if share <= before:
            return placed.withColumn("target", F.when(full, F.col("size") * float(cap)).otherwise(F.col("weight") * F.lit(share)))
        full = F.col("weight") * F.lit(share) >= F.col("size") * float(cap)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of `docs`, and the columns that `carry` names.

    `taken` is a multiple of the row's size: the complete epochs, and one more if the row is in the weighted sample. The
    row at which the sample reaches its target is in it if that comes nearer to the target. Keys come from a
    hash of id and text, so reruns agree, whatever the partitions; rows equal in both get equal keys, are of one size and go by a
    hash of what they carry. Other columns don't matter, whatever their names. Null texts have no words and are never taken; null sources are one source.
    Very long texts are one document like any other. An empty table gives an empty one.
    """
    unit = (F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit(""))))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    drawn = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.struct(*carry, F.lit(0).alias("_")).alias("carried"), word_count(text_col).alias("size"), (-F.log(unit) / quality_weight(text_col)).alias("key"))
    # Rows of equal keys are in the order of what they carry, so reruns agree; those that carry the same are alike and only have to be parted.
    drawn = cut(drawn.withColumns({"other": F.xxhash64("carried"), "tie": F.xxhash64(F.monotonically_increasing_id())}), "drawn")
    totals = drawn.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    planned = targets(totals, budget, weights).select(F.col("source").alias("of"), F.col("size").alias("source_size"), "n", "target")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    planned = planned.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < MAX_EPOCHS, F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(0.0))
    planned = cut(planned, "plan")
    sums = planned.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    hint = (lambda df: F.broadcast(df)) if sums.sources <= BROADCAST_SOURCES else (lambda df: df.hint("merge"))

    ranges = max(1, -(-sums["rows"] // RANGE_ROWS))
    ranged = cut(drawn.repartitionByRange(ranges, "source", "key", "other", "tie").withColumn("range", F.spark_partition_id()), "ranged")
    drop(drawn)
    by_range = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    by_range = by_range.select("source", "range", (up_to - F.col("words")).alias("before"), up_to.alias("after"))
    crossing = by_range.join(hint(planned.select("of", "rest")), F.col("source").eqNullSafe(F.col("of"))).where((F.col("before") <= F.col("rest")) & (F.col("after") > F.col("rest")))
    crossing = cut(crossing.select(F.col("source").alias("at_source"), F.col("range").alias("at"), "before"), "crossing")

    with_plan = ranged.join(hint(planned.drop("n")), F.col("source").eqNullSafe(F.col("of"))).join(hint(crossing), F.col("source").eqNullSafe(F.col("at_source")), "left")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "other", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = with_plan.where(F.col("range") == F.col("at")).withColumn("sum", F.col("before") + F.sum("size").over(order))
    over, under = F.col("sum") - F.col("rest"), F.col("rest") - (F.col("sum") - F.col("size"))
    inside = (F.col("sum") <= F.col("rest")) | ((under > 0) & (over < under))
    taken = lambda also: (F.col("size") * (F.col("epochs") + F.when(also, 1).otherwise(0))).cast("long").alias("taken")
    columns = ["doc_id", "source", "size", "source_size", "target", *(f"carried.{c}" for c in carry)]
    ends = summed.select(*columns, taken(inside & (F.col("rest") > 0)))
    rest = with_plan.where(F.col("at").isNull() | (F.col("range") != F.col("at")))
    return rest.select(*columns, taken((F.col("rest") > 0) & (F.col("at").isNull() | (F.col("range") < F.col("at"))))).unionByName(ends)
