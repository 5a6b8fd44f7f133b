"""Event streams: windowed counts, sessions and running counters. An extension: the batch engine's counterparts have no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENT, per_trigger: int | None = None) -> DataFrame:
    """Events from files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; events later than `late` are left out. Works on streams and tables."""
    by = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", (F.col("cents") / 100).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def recent_means(events: DataFrame, rows: int = 50) -> DataFrame:
    """Mean of each type's last `rows` values as the stream goes, from state of that many numbers a type."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        fresh = pd.concat(list(batches)).sort_values(["ts", "event_id"]).value.dropna().tolist()
        kept = (kept + fresh)[-rows:]
        state.update((kept,))
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(kept)], "mean": [sum(kept) / len(kept) if kept else None]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, n int, mean double", "kept array<double>", "update", "NoTimeout")
