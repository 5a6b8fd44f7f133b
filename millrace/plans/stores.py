"""Queries that write a table, file or log and read it back by the engine's own sources and sinks.

What they write lies in the shared scratch folder; the results read it lazily, so it stays there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import IndexMissing
from millrace.operators import governance, lifecycle
from millrace.plans.catalog import query
from millrace.session import scratch, table
from millrace.sources import readers, sinks


@query(
    "src10_changed_files",
    """WITH s AS (SELECT '/in/' || coalesce(source, 'none') || '/' || (doc_id % 400) || '.pdf' AS path, (doc_id % 400) || '.pdf' AS name, CAST(doc_id AS INTEGER) AS made FROM documents),
    k AS (SELECT (doc_id % 400) || '.pdf' AS name, CAST(max(doc_id) AS INTEGER) AS have FROM labels WHERE quality = 1 GROUP BY 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY made DESC, path DESC) AS r FROM s)
    SELECT n.path, n.name, n.made AS "modificationTime" FROM n LEFT JOIN k ON n.name = k.name WHERE r = 1 AND (have IS NULL OR made > have)""",
)
def src10_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, STM-06: files that are new or newer than the copy of their name; documents stand for files, good ones for those copied before."""
    name = F.concat((F.col("doc_id") % 400).cast("string"), F.lit(".pdf"))
    source = table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), F.coalesce("source", F.lit("none")), F.lit("/"), name).alias("path"), F.col("doc_id").cast("int").alias("modificationTime"))
    known = table(spark, sf_dir, "labels").where("quality = 1").groupBy(name.alias("name")).agg(F.max("doc_id").cast("int").alias("modificationTime"))
    return readers.changed_files(source, known)


@query("src20_past_day", "SELECT o_orderstatus AS status, count(*) AS n, '1995-03-15' AS day FROM orders WHERE o_orderdate <= DATE '1995-03-15' GROUP BY 1")
def src20_past_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21..SRC-26: the past day's version of a named query, its day a parameter."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("registry_orders")
    past = "SELECT o_orderstatus AS status, count(*) AS n, :d AS day FROM registry_orders WHERE o_orderdate <= to_date(:d) GROUP BY 1"
    return readers.NamedQueries({"orders": "SELECT o_orderstatus AS status, count(*) AS n, NULL AS day FROM registry_orders GROUP BY 1"}, {"orders": past}).run(spark, "orders", "1995-03-15")


@query(
    "src31_sql_files",
    """SELECT n_nationkey, 0 AS entry, 'SELECT * FROM shop.' || replace(lower(n_name), ' ', '_') || ' a JOIN region r ON r.k = ' || n_regionkey AS sql, 'SHOP.' || replace(n_name, ' ', '_') || ',REGION' AS tables FROM nation
    UNION ALL SELECT n_nationkey, 2, 'select count(*) from t' || n_nationkey, 'T' || n_nationkey FROM nation""",
)
def src31_sql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-31, SRC-32: a file of statements and notes for each nation, written, found in its folder and split."""
    path = scratch(spark, "sql-files")
    name = F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))
    first = F.concat(F.lit("SELECT * FROM shop."), name, F.lit(" a JOIN region r ON r.k = "), F.col("n_regionkey").cast("string"))
    whole = F.concat(first, F.lit("\n\n\n\nonly notes\n---\nselect count(*) from t"), F.col("n_nationkey").cast("string"))
    table(spark, sf_dir, "nation").select("n_nationkey", whole.alias("value")).write.partitionBy("n_nationkey").text(path)
    entries = readers.sql_entries(readers.texts(spark, path))
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int")
    return entries.select(key.alias("n_nationkey"), "entry", "sql", F.array_join("tables", ",").alias("tables"))


@query("src36_feedback_lines", "SELECT conv_id, turn, md5(text) AS h FROM conversations WHERE role = 'user'")
def src36_feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-36, SNK-08: rows appended as lines of JSON in two writes, and a broken line among them, which the reader leaves out."""
    path = scratch(spark, "feedback")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    sinks.append_log(rows.where("conv_id % 2 = 0"), path)
    sinks.append_log(rows.where("conv_id % 2 = 1"), path)
    spark.range(1).select(F.lit('{"conv_id": broken').alias("value")).write.mode("append").text(path)
    return readers.jsonl(spark, path, "conv_id long, turn int, text string").where("conv_id IS NOT NULL").select("conv_id", "turn", F.md5("text").alias("h"))


@query("src38_evaluations", "SELECT r_regionkey, r_name FROM region")
def src38_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-38, SNK-09, SNK-10: one file with an array of objects; the region table is five rows at any size."""
    path = scratch(spark, "evaluations")
    table(spark, sf_dir, "region").select(F.struct("r_regionkey", "r_name").alias("r")).agg(F.to_json(F.collect_list("r")).alias("value")).write.text(path)
    return readers.json_array(spark, path, "r_regionkey int, r_name string")


@query("src39_registry", "SELECT n_name AS key, n_regionkey, n_nationkey FROM nation")
def src39_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-39: a file with an object of objects; the nation table is 25 rows at any size."""
    path = scratch(spark, "registry")
    entry = F.struct("n_name", F.struct("n_regionkey", "n_nationkey")).alias("e")
    table(spark, sf_dir, "nation").select(entry).agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).write.text(path)
    return readers.json_registry(spark, path, "n_regionkey int, n_nationkey int")


@query("snk01_versions", "SELECT v AS version, count(*) AS n FROM (SELECT unnest(range(3, 8)) AS v) JOIN supplier ON s_suppkey % 8 < v GROUP BY v")
def snk01_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02, SNK-04, SNK-05: seven versions of an index; all but the newest five are pruned, those are whole."""
    path, rows = scratch(spark, "versions"), table(spark, sf_dir, "supplier").select("s_suppkey")
    for v in range(1, 8):
        sinks.write_version(rows.where(F.col("s_suppkey") % 8 < v), path, v)
    sinks.prune_versions(spark, path, 5)
    return spark.read.option("basePath", path).parquet(*(f"{path}/version={v}" for v in sinks.versions(spark, path))).groupBy(F.col("version").cast("long").alias("version")).agg(F.count("*").alias("n"))


@query("snk03_append", "SELECT doc_id, md5(text) AS h FROM documents")
def snk03_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, SRC-34, SRC-35: an index built from one part of the documents, to which the other part is appended."""
    path, docs = scratch(spark, "index"), table(spark, sf_dir, "documents").select("doc_id", "text")
    sinks.write_version(docs.where("doc_id % 3 <> 0"), path, 1)
    sinks.append_version(docs.where("doc_id % 3 = 0"), path, 1)
    return sinks.latest(spark, path).select("doc_id", F.md5("text").alias("h"))


@query("snk06_fallback", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def snk06_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, SNK-02: of three versions the newest has its last file cut short, so readers get the one before; its other files are whole."""
    path, rows = scratch(spark, "fallback"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.write_version(rows, path, 1)
    sinks.write_version(rows.where("c_custkey % 2 = 0"), path, 2)
    sinks.write_version(rows.repartitionByRange(4, "c_custkey"), path, 3)
    sinks.shorten_last_file(spark, f"{path}/version=3")
    return sinks.latest(spark, path)


@query(
    "snk10_restore",
    """SELECT 'current' AS step, 3 AS version, count(*) AS n, sum(c_custkey) AS keys FROM customer UNION ALL SELECT 'restored', 1, count(*), sum(c_custkey) FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'refused', 1, count(*), sum(c_custkey) FROM customer WHERE c_custkey % 3 = 0""",
)
def snk10_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: an earlier version made current; then another one that a lost file has spoilt, which is refused and changes nothing."""
    path, rows = scratch(spark, "restore"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.write_version(rows.where("c_custkey % 3 = 0"), path, 1)
    sinks.write_version(rows.where("c_custkey % 3 = 1").repartition(3), path, 2)
    sinks.write_version(rows, path, 3)
    shown = lambda step: sinks.latest(spark, path).agg(F.lit(step).alias("step"), F.lit(sinks.current(spark, path)).alias("version"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
    out = shown("current")
    sinks.restore(spark, path, 1)
    out = out.unionByName(shown("restored"))
    sinks.shorten_last_file(spark, f"{path}/version=2")
    try:
        sinks.restore(spark, path, 2)
    except IndexMissing:
        out = out.unionByName(shown("refused"))
    return out


@query("snk07_feedback_log", "SELECT doc_id, md5(substr(text, 1, 2000)) AS question, md5(substr(text, 1, 5000)) AS answer FROM documents")
def snk07_feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: questions of at most 2000 and answers of at most 5000 characters, which is the log's feature."""
    path, docs = scratch(spark, "log"), table(spark, sf_dir, "documents")
    sinks.append_log(docs.select("doc_id", F.col("text").alias("question"), F.col("text").alias("answer")), path, {"question": 2000, "answer": 5000})
    return readers.jsonl(spark, path, "doc_id long, question string, answer string").select("doc_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("snk11_training", "SELECT md5(text) AS prompt, md5(role || conv_id) AS completion FROM conversations WHERE conv_id % 3 = 0")
def snk11_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: what got positive feedback as prompts and completions; every third conversation stands for it."""
    path = scratch(spark, "training")
    liked = F.when(F.col("conv_id") % 3 == 0, "positive").otherwise("negative").alias("feedback")
    sinks.export_training(table(spark, sf_dir, "conversations").select(liked, F.col("text").alias("question"), F.concat("role", F.col("conv_id").cast("string")).alias("answer")), path)
    return readers.jsonl(spark, path, "prompt string, completion string").select(F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


@query("snk13_event_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, replace(props, ',', '，') AS props FROM events")
def snk13_event_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, SNK-13, SRC-40: a CSV export whose texts hold no comma, read back as strings with its columns required."""
    path = scratch(spark, "csv")
    sinks.export_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), path)
    return readers.csv_strings(spark, path, ["event_id", "event_type", "props"])


@query("snk15_statements", "SELECT 'analyst' AS actor, substr(text, 1, 200) AS statement, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_rows, doc_id % 1000 AS ms, CASE WHEN doc_id % 5 = 0 THEN substr('rejected: ' || text, 1, 200) END AS error FROM documents")
def snk15_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15: an audit of statements, failed ones too, with the first 200 characters of each; texts stand for statements."""
    docs = table(spark, sf_dir, "documents")
    error = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("rejected: "), "text"))
    return docs.select(*lifecycle.statement_audit(F.col("text"), "analyst", F.col("n_chars"), F.col("doc_id") % 1000, error)).withColumn("n_rows", F.col("n_rows").cast("long"))


@query("gov03_row_limit", "SELECT count(*) AS n, least(count(*), 100) AS shown FROM lineitem WHERE l_quantity > 10")
def gov03_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GOV-03: a statement's rows up to the limit of its access; the statement's own LIMIT counts where it is smaller."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("gov_limited")
    sql = "SELECT l_orderkey FROM gov_limited WHERE l_quantity > 10"
    shown = governance.guarded(spark, sql + " LIMIT 1000000", governance.Access({"gov_limited"}, max_rows=100)).agg(F.count("*").alias("shown"))
    return table(spark, sf_dir, "lineitem").where("l_quantity > 10").agg(F.count("*").alias("n")).crossJoin(F.broadcast(shown))


@query(
    "gov04_checks",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'rejected' ELSE 'ran' END AS outcome, CASE WHEN n_nationkey % 3 <> 0 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS n FROM nation""",
)
def gov04_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GOV-04, GOV-05, GOV-09, OBS-04: a statement for each nation, every third of a column or table that isn't there or isn't listed: rejected before it runs, and not worth another try."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("gov_checked")
    access, rows = governance.Access({"gov_checked"}), []
    for key in range(25):
        source = "gov_checked" if key % 3 else ("gov_missing" if key % 2 else "gov_checked WHERE c_missing = 1 OR")
        try:
            found = governance.guarded(spark, f"```sql\nSELECT count(*) AS n FROM {source} {'WHERE' if 'WHERE' not in source else ''} c_nationkey = {key};\n```", access)
            rows.append(found.select(F.lit(key).alias("n_nationkey"), F.lit("ran").alias("outcome"), "n"))
        except governance.Rejected:
            rows.append(spark.range(1).select(F.lit(key).alias("n_nationkey"), F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("n")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
