"""Session factory and table access."""

from __future__ import annotations

import json
import logging
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger("millrace")

#: Rows of a small table that goes to every task, at most.
SENT_ROWS = 100_000

#: The tables that the driver provides.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` overrides single settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only what the plan uses of it is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Registers the tables of a directory as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir; in local mode, if none is set, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new path of the shared folder and read back: computed once, without lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, made_of: DataFrame) -> DataFrame:
    """`df`, to go to every task as it is if the stored rows that it is made of are few, whatever their bytes; else as it is."""
    return F.broadcast(df) if made_of.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def write_folders(df: DataFrame, path: str, by: str, **options: str) -> None:
    """`df` in folders by a column, with its schema beside them, so that an empty table can be read as well."""
    df.write.options(**options).partitionBy(by).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores if it has fewer partitions than these, as a small file has; large tables stay as they are. For heavy work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def timed(what: str, slow: float = 0.5) -> Iterator[dict[str, float]]:
    """Logs how long a block of actions took, as a warning from `slow` seconds on, failed blocks too; the yielded dict gets "seconds"."""
    began, out = time.perf_counter(), {}
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        LOG.log(logging.WARNING if out["seconds"] >= slow else logging.INFO, "%s took %.3f s", what, out["seconds"])


def warm(df: DataFrame) -> DataFrame:
    """The table, kept by the executors and read once, so that the first search needn't; what doesn't fit in memory goes to their disks."""
    df = df.persist()
    df.count()
    return df
