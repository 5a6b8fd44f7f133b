"""Two-sided reconciliation, lookups and assignment by anti- and semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, amount: str) -> DataFrame:
    """key, our_amount, their_amount and status of every key on either side.

    A zero amount counts as absent. Each side has one row per key.
    """
    both = ours.select(key, F.col(amount).alias("our_amount")).join(theirs.select(key, F.col(amount).alias("their_amount")), key, "full")
    have = [F.coalesce(F.col(c), F.lit(0)) != 0 for c in ("our_amount", "their_amount")]
    status = (
        F.when(have[0] & have[1] & (F.col("our_amount") == F.col("their_amount")), "ok")
        .when(have[0] & have[1], "amount_diff")
        .when(have[1], "missing")
        .when(have[0], "ours_only")
        .otherwise("empty")
    )
    return both.withColumn("status", status)


def match_rate(statuses: DataFrame) -> DataFrame:
    """Counts by status and the share of `ok` among what the other side reports; rows only we have don't count."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = statuses.agg(n("ok").alias("ok"), n("missing").alias("missing"), n("amount_diff").alias("amount_diff"), n("ours_only").alias("ours_only"))
    return counted.withColumn("match_rate_pct", F.round(F.col("ok") * 100.0 / F.greatest(F.col("ok") + F.col("missing") + F.col("amount_diff"), F.lit(1)), 1))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a lookup that is filled in order ends up with."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")).withColumn("rank", rank).where("rank = 1").drop("rank")


def free_places(places: DataFrame, taken: DataFrame, room: str, sex: str, wanted: str) -> DataFrame:
    """Free places in rooms that nobody of another known sex is in, those with somebody of the wanted sex first."""
    others = taken.where((F.col(sex) != wanted) & F.col(sex).isin("F", "M")).select(room).distinct()
    same = taken.where(F.col(sex) == wanted).select(room).distinct().withColumn("same_sex", F.lit(True))
    return places.join(others, room, "left_anti").join(same, room, "left").withColumn("same_sex", F.coalesce("same_sex", F.lit(False)))


def prefix_match(texts: DataFrame, probes: DataFrame, length: int, text: str, probe: str, order: str) -> DataFrame:
    """Each probe with the first text that starts with the probe's first `length` characters: an equi-join on the prefix.

    Texts that are shorter than `length` only match probes of their own length.
    """
    keyed = texts.withColumn("prefix", F.substring(text, 1, length))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(order))
    first = keyed.withColumn("rank", rank).where("rank = 1").drop("rank")
    return probes.withColumn("prefix", F.substring(probe, 1, length)).join(first, "prefix", "left").drop("prefix")
