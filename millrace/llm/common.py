"""What the operators of this subpackage share: tables, scratch tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text in one Arrow batch; they bound a Python worker's memory (a longer text is a batch of its own).
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 256, 8 << 20
#: Spark removes a query's shuffle files when it ends, if this is set while it runs.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode, if none is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes `df` as a table in the shared scratch folder and reads it back: its lineage ends there.

    The shuffle files of the plan that made it go with it; the table itself stays until `drop`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what `cut` wrote for these tables; nothing that is still to be computed may read them."""
    for df in tables:
        spark, path = df.sparkSession, df.scratch_path
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over texts, in batches of at most TEXT_BATCH_ROWS rows and about TEXT_BATCH_BYTES.

    Spark reads both limits from the session when the plan runs, so they stay set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`map_texts` by a function that only leaves rows out; columns keep their places, names of any signs and types."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return map_texts(plain, fn, plain.schema).toDF(*df.columns)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the value as text, modulo m; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)


def lower_words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
