"""Document versions, chunks and their audit, as rewrites of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, DEPRECATED, DELETED = "active", "deprecated", "deleted"


def upload(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after an upload of documents (doc_id, title, category, file_hash, created_at).

    A file that the registry has, active, by hash is skipped, as are repeats within the upload. A document gets the version
    after the last of its title and category; earlier versions become deprecated.
    """
    known = registry.where(F.col("status") == ACTIVE).select("file_hash").distinct()
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("created_at", "doc_id"))
    fresh = new.withColumn("k", first).where("k = 1").drop("k").join(known, "file_hash", "left_anti")
    last = registry.groupBy("title", "category").agg(F.max("version").alias("last"))
    order = F.row_number().over(Window.partitionBy("title", "category").orderBy("created_at", "doc_id"))
    newest = order == F.count("*").over(Window.partitionBy("title", "category"))
    added = fresh.join(last, ["title", "category"], "left").select(
        "doc_id", "title", "category", "file_hash", "created_at", (F.coalesce("last", F.lit(0)) + order).cast("int").alias("version"), F.when(newest, ACTIVE).otherwise(DEPRECATED).alias("status"))
    replaced = added.select("title", "category").distinct().withColumn("replaced", F.lit(True))
    kept = registry.join(replaced, ["title", "category"], "left")
    old = F.when(F.col("replaced") & (F.col("status") == ACTIVE), DEPRECATED).otherwise(F.col("status"))
    return kept.select("doc_id", "title", "category", "file_hash", "created_at", "version", old.alias("status")).unionByName(added)


def rollback(registry: DataFrame, title: str, version: int) -> DataFrame:
    """The registry with one version of a title active and its others deprecated; unchanged without that version."""
    mine = F.col("title") == title
    there = F.max(F.when(F.col("version") == version, 1).otherwise(0)).over(Window.partitionBy("title")) == 1
    status = F.when(mine & there & (F.col("version") == version), ACTIVE).when(mine & there & (F.col("status") == ACTIVE), DEPRECATED).otherwise(F.col("status"))
    return registry.withColumn("status", status)


def set_status(df: DataFrame, which: Column, status: str) -> DataFrame:
    """Rows that meet a condition with another status, e.g. soft-deleted, pending or indexed."""
    return df.withColumn("status", F.when(which, F.lit(status)).otherwise(F.col("status")))


def replace_chunks(chunks: DataFrame, doc_id, new: DataFrame) -> DataFrame:
    """A document's chunks soft-deleted and its new ones added as pending."""
    old = chunks.withColumn("is_deleted", F.col("is_deleted") | (F.col("doc_id") == doc_id))
    return old.unionByName(new.withColumns({"status": F.lit("pending"), "is_deleted": F.lit(False)}).select(*chunks.columns))


def without_source(index: DataFrame, source: str) -> DataFrame:
    """An index without one source; all columns stay. The last source stays too."""
    others = index.agg(F.coalesce(F.max(F.col("source") != source), F.lit(False)).alias("_others"))
    return index.crossJoin(F.broadcast(others)).where((F.col("source") != source) | ~F.col("_others")).drop("_others")  # one row


def page_count(rows: Column, size: int = 15) -> Column:
    return F.greatest(F.ceil(rows / size), F.lit(1))


def audit(action: str, target: Column, who: str, at: Column) -> list[Column]:
    """The columns of an audit row."""
    return [F.lit(action).alias("action"), target.cast("string").alias("target"), F.lit(who).alias("actor"), at.alias("at")]


def statement_audit(statement: Column, who: str, rows: Column, milliseconds: Column, error: Column) -> list[Column]:
    """The columns of an audit row for a statement that ran or failed: its first 200 characters, and why it failed."""
    return [
        F.lit(who).alias("actor"), F.substring(statement, 1, 200).alias("statement"), F.when(error.isNull(), "ok").otherwise("failed").alias("outcome"),
        F.when(error.isNull(), rows).cast("long").alias("n_rows"), milliseconds.cast("long").alias("ms"), F.substring(error, 1, 200).alias("error"),
    ]
