"""Files taken in as they come: each is read once, and a repeated batch adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_batch(rows: DataFrame, batch: int, target: str) -> None:
    """A batch as a folder `batch=N` of its own, whatever it held before: a batch that runs again, after a failure, replaces itself."""
    rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, kind: str = "json", files: int | None = None) -> int:
    """Takes in what `source` has that earlier runs with this checkpoint haven't, in batches of `files` files at most, and ends; gives the number of batches.

    The checkpoint knows the files of each batch. If a run ends between a batch's write and its commit, the next run repeats that batch with the same files and number.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    writer = reader.format(kind).load(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    run = writer.foreachBatch(lambda rows, batch: write_batch(change(rows), batch, target)).start()
    run.awaitTermination()
    return sum(1 for p in run.recentProgress if p["numInputRows"] > 0)


def taken(spark: SparkSession, target: str) -> DataFrame:
    """All rows taken in so far, with their batch."""
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*")
