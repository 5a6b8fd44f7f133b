"""Governance, profiling, lifecycle and event queries on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import governance, lifecycle, profile
from millrace.plans.catalog import query
from millrace.session import table
from millrace.streaming import events as streams


@query("gov01_guarded_sql", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) GROUP BY 1")
def gov01_guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GOV-01..GOV-09, SRC-11: a statement over listed tables, checked in its whole plan."""
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"gov_{name}")
    sql = "```sql\nSELECT o_orderstatus, count(*) AS n FROM gov_orders WHERE o_orderkey IN (SELECT l_orderkey FROM gov_lineitem WHERE l_quantity > 40) GROUP BY 1;\n```"
    return governance.guarded(spark, sql, governance.Access({"gov_orders", "gov_lineitem"}))


@query("gov02_guarded_masking", "SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS c_name FROM customer")
def gov02_guarded_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-13, SRC-27: listed columns are masked in any statement."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("gov_customer")
    access = governance.Access({"gov_customer"}, {"gov_customer": {"c_name": "name"}}, max_rows=1 << 30)
    return governance.guarded(spark, "SELECT c_custkey, c_name FROM gov_customer", access)


@query("ana07_summary", "SELECT 'l_linenumber' AS name, count(*) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS total, CAST(min(l_linenumber) AS DOUBLE) AS least, CAST(max(l_linenumber) AS DOUBLE) AS most FROM lineitem")
def ana07_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-27."""
    return profile.summarise(table(spark, sf_dir, "lineitem").select("l_linenumber")).drop("mean")


@query(
    "ana10_column_shares",
    """SELECT 'o_orderstatus' AS name, count(o_orderstatus) AS n, 0.0::DOUBLE AS dates, 0.0::DOUBLE AS times, 0.0::DOUBLE AS numbers, count(DISTINCT o_orderstatus) AS values FROM orders
    UNION ALL SELECT 'o_shippriority', count(*), 0.0, 0.0, 1.0, 3 FROM orders""",
)
def ana10_column_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA-01, ANA-02, ANA-04: what values look like, over all rows in one pass."""
    return profile.value_shares(table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 3).alias("o_shippriority")))


REGISTRY = """r AS (SELECT doc_id, source AS title, lang AS category, md5(text) AS file_hash, doc_id AS created_at, doc_id % 2 AS part FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, file_hash ORDER BY created_at, doc_id) AS k FROM r) WHERE k = 1),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY title, category ORDER BY created_at, doc_id) AS INTEGER) AS version, count(*) OVER (PARTITION BY title, category) AS n FROM f WHERE part = 0),
a AS (SELECT * FROM f WHERE part = 1 AND file_hash NOT IN (SELECT file_hash FROM o WHERE version = n)),
v AS (SELECT a.*, CAST(row_number() OVER (PARTITION BY a.title, a.category ORDER BY created_at, doc_id) + coalesce(l.n, 0) AS INTEGER) AS version, row_number() OVER (PARTITION BY a.title, a.category ORDER BY created_at DESC, doc_id DESC) = 1 AS newest
      FROM a LEFT JOIN (SELECT DISTINCT title, category, n FROM o) l ON a.title = l.title AND a.category = l.category)"""


@query(
    "cms01_upload",
    f"""WITH {REGISTRY} SELECT doc_id, version, CASE WHEN newest THEN 'active' ELSE 'deprecated' END AS status FROM v
    UNION ALL SELECT doc_id, version, CASE WHEN version = n AND NOT EXISTS (SELECT 1 FROM v WHERE v.title = o.title AND v.category = o.category) THEN 'active' ELSE 'deprecated' END FROM o""",
)
def cms01_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMS-01, CMS-09, WIN-04, JOIN-19: half of the documents as a registry, the other half uploaded to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("category"), F.md5("text").alias("file_hash"), F.col("doc_id").alias("created_at"))
    empty = docs.limit(0).withColumns({"version": F.lit(0), "status": F.lit("")})
    registry = lifecycle.upload(empty, docs.where("doc_id % 2 = 0"))
    return lifecycle.upload(registry, docs.where("doc_id % 2 = 1")).select("doc_id", "version", "status")


@query("cms04_soft_delete", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'deleted' ELSE 'active' END AS status FROM documents")
def cms04_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMS-03..CMS-06, CMS-10, FLT-12: a status set where a condition holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(lifecycle.ACTIVE).alias("status"))
    return lifecycle.set_status(docs, F.col("lang") == "fr", lifecycle.DELETED).select("doc_id", "status")


@query("cms11_without_source", "SELECT doc_id, source FROM documents WHERE source <> 'src1'")
def cms11_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMS-11, CMS-12."""
    return lifecycle.without_source(table(spark, sf_dir, "documents").select("doc_id", "source"), "src1")


@query("cms17_pages", "SELECT source, count(*) AS chunks, CAST(greatest(ceil(count(*) / 15), 1) AS BIGINT) AS pages, round(count_if(lang = 'en') / count(*), 4) AS indexed FROM documents GROUP BY source ORDER BY chunks DESC, source LIMIT 15")
def cms17_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMS-16, CMS-17."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("lang") == "en").alias("en"))
    return counts.select("source", "chunks", lifecycle.page_count(F.col("chunks")).alias("pages"), F.round(F.col("en") / F.col("chunks"), 4).alias("indexed")).orderBy(F.desc("chunks"), "source").limit(15)


@query(
    "stm01_hourly_counts",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100 AS value FROM events GROUP BY 1, 2",
)
def stm01_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01: the plan that also runs on the stream (tests compare both)."""
    rows = streams.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stm02_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def stm02_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("obs03_event_viewer", "SELECT event_id, event_type, substr(props, 1, 40) AS detail FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) ORDER BY ts DESC, event_id DESC LIMIT 200")
def obs03_event_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBS-03, SRC-37: the newest 200 of the two most frequent types; the limit is the viewer's."""
    rows = table(spark, sf_dir, "events")
    top = rows.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(2)
    return rows.join(F.broadcast(top), "event_type", "left_semi").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", F.substring("props", 1, 40).alias("detail"))
