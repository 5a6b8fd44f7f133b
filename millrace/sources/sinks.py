"""Sinks: versioned tables with manifests, appended logs, exports.

A version of a table is a folder `version=N` with a manifest: its files with their lengths, the number of rows, and a checksum that doesn't depend on their order. The file
CURRENT names the version that readers get; it is put in place by one rename, so a reader sees the old version or the new one, never a mixture.
"""

from __future__ import annotations

import json

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import IndexMissing

MANIFEST, CURRENT = "_manifest.json", "CURRENT"


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Spark's own file system for a path, and the path; any store that Spark reaches will do."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and renamed into it."""
    jvm = spark.sparkContext._jvm
    files, beside = _at(spark, path + ".new")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    place = _at(spark, path)[1]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, place, replace)


def _get(spark: SparkSession, path: str) -> str | None:
    files, place = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """The data files below a folder and their lengths."""
    files, place = _at(spark, folder)
    found, out, cut = files.listFiles(place, True), {}, len(files.makeQualified(place).toString()) + 1
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()[cut:]
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            out[name] = status.getLen()
    return out


def checksum(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and the sum of a hash of each; equal for equal rows in any order, and repeated rows count."""
    plain = lambda f: F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    columns: list[Column] = [plain(f) for f in df.schema.fields]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns, *(c.isNull() for c in columns)).cast("decimal(38,0)")).alias("h")).first()
    return row.n, str(row.h or 0)


def _seal(spark: SparkSession, folder: str) -> None:
    n, h = checksum(spark.read.parquet(folder)) if (files := _listed(spark, folder)) else (0, "0")
    _put(spark, f"{folder}/{MANIFEST}", json.dumps({"files": files, "rows": n, "checksum": h}))


def write_version(df: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    """Writes a whole new version beside the earlier ones, seals it with its manifest, makes it current and gives its path; readers of earlier ones are not disturbed."""
    spark, target = df.sparkSession, f"{path}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    _seal(spark, target)
    _put(spark, f"{path}/{CURRENT}", str(version))
    return target


def append_version(df: DataFrame, path: str, version: int) -> None:
    """Adds rows to a version and seals it anew; until then it doesn't verify, and readers get the one before."""
    target = f"{path}/version={version}"
    df.write.mode("append").parquet(target)
    _seal(df.sparkSession, target)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions under a path, newest first."""
    files, folder = _at(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted((int(n.split("=")[1]) for n in names if n.startswith("version=")), reverse=True)


def current(spark: SparkSession, path: str) -> int | None:
    """The version that CURRENT names, or the newest, if there is none such."""
    named = _get(spark, f"{path}/{CURRENT}")
    return int(named) if named else next(iter(versions(spark, path)), None)


def fault(spark: SparkSession, path: str, version: int, deep: bool = True) -> str | None:
    """What is wrong with a version, None if nothing: its files against the manifest, and, if `deep`, all its rows."""
    folder = f"{path}/version={version}"
    if (text := _get(spark, f"{folder}/{MANIFEST}")) is None:
        return "no manifest"
    told, there = json.loads(text), _listed(spark, folder)
    if gone := sorted(set(told["files"]) - set(there)):
        return f"files missing: {', '.join(gone)}"
    if odd := sorted(f for f, n in there.items() if told["files"].get(f) != n):
        return f"files of other lengths: {', '.join(odd)}"
    if deep and there:
        try:
            if (got := checksum(spark.read.parquet(folder))) != (told["rows"], told["checksum"]):
                return f"{got[0]} rows where {told['rows']} were written, or others"
        except Exception as e:  # whatever a reader may say of damaged bytes
            return f"unreadable: {type(e).__name__}"
    return None


def shorten_last_file(spark: SparkSession, folder: str) -> None:
    """Cuts the last data file below a folder by half, as a broken copy would; for drills."""
    name = max(_listed(spark, folder))
    files, place = _at(spark, f"{folder}/{name}")
    stream = files.open(place)
    whole = bytes(stream.readAllBytes())
    stream.close()
    out = files.create(place, True)
    out.write(bytearray(whole[: len(whole) // 2]))
    out.close()


def restore(spark: SparkSession, path: str, version: int) -> None:
    """Makes an earlier version current, if it verifies; else nothing changes and the fault is raised."""
    if wrong := fault(spark, path, version):
        raise IndexMissing(f"version {version} under {path} stays as it is: {wrong}")
    _put(spark, f"{path}/{CURRENT}", str(version))


def prune_versions(spark: SparkSession, path: str, keep: int = 5) -> list[int]:
    """Removes all but the newest versions; gives the removed."""
    old = versions(spark, path)[keep:]
    for v in old:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return old


def latest(spark: SparkSession, path: str, deep: bool = True) -> DataFrame:
    """The current version if it verifies, else the newest before it that does."""
    now, told = current(spark, path), []
    for v in versions(spark, path):
        if v <= now:
            if (wrong := fault(spark, path, v, deep)) is None:
                return spark.read.parquet(f"{path}/version={v}")
            told.append(f"version {v}: {wrong}")
    raise IndexMissing(f"no sound version under {path}" + "".join(f"; {x}" for x in told))


def append_log(df: DataFrame, path: str, limits: dict[str, int] | None = None) -> None:
    """Appends rows as lines of JSON; long texts are cut to their limits."""
    cut = {c: F.substring(c, 1, n) for c, n in (limits or {}).items()}
    df.withColumns(cut).write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; commas in texts become full-width ones, so that every reader sees the same columns."""
    texts = {f.name: F.regexp_replace(f.name, ",", "，") for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df.withColumns(texts).write.mode("overwrite").option("header", True).csv(path)


def export_training(feedback: DataFrame, path: str) -> None:
    """Positive feedback as prompts and completions."""
    feedback.where(F.col("feedback") == "positive").select(F.col("question").alias("prompt"), F.col("answer").alias("completion")).write.mode("overwrite").json(path)
