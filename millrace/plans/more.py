"""Further operators of each family on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import coerce, text
from millrace.operators import embed, filters, lifecycle, retrieval, topn
from millrace.plans.catalog import query
from millrace.plans.relational import VISITS, visits
from millrace.session import table
from millrace.sources import readers


@query("agg03_remaining", "SELECT p_brand, CAST(sum(greatest(p_size - 25, 0)) AS BIGINT) AS remaining, round(sum(greatest(p_size - 25, 0)) * 100.0::DOUBLE / greatest(sum(p_size), 1), 1) AS capacity_pct FROM part GROUP BY 1")
def agg03_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.sum(F.greatest(F.col("p_size") - 25, F.lit(0)))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(left.alias("remaining"), coerce.ratio_pct(left, F.sum("p_size")).alias("capacity_pct"))


@query("agg25_mean_by_mode", "SELECT event_type AS mode, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100 * count(value)), 6) AS mean FROM events GROUP BY 1")
def agg25_mean_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.round(cents / (F.count("value") * 100), 6).alias("mean"))


@query("agg29_auto_precision", "SELECT vec_id, len(list_filter(embedding[1:10], lambda x: x >= 0.1)) / 10 AS precision FROM embeddings")
def agg29_auto_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", embed.precision_at(F.slice("embedding", 1, 10)).alias("precision"))


@query("win01_ranks", "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rk FROM lineitem QUALIFY rk <= 100")
def win01_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return topn.top_per_group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 100).select("l_orderkey", "l_linenumber", "l_extendedprice", "rk")


@query("srt04_one_row", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1")
def srt04_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that a report takes, with an order that says which."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(1)


@query("srt08_choice_of_order", "WITH s AS (SELECT source, count(*) AS chunks, max(doc_id) AS uploaded FROM documents GROUP BY 1) SELECT source, chunks, uploaded, CAST(row_number() OVER (ORDER BY uploaded DESC, source) AS INTEGER) AS place FROM s")
def srt08_choice_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name ascending, chunks or upload descending."""
    orders = {"name": [F.col("source")], "chunks": [F.desc("chunks"), F.col("source")], "uploaded": [F.desc("uploaded"), F.col("source")]}
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.max("doc_id").alias("uploaded"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(*orders["uploaded"])))


@query("set04_missing", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set04_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").distinct()


@query("flt02_prefer_totals", f"WITH {VISITS} SELECT strftime(day, '%Y-%m') AS month, CAST(sum(amount) AS DOUBLE) AS amount FROM visits WHERE dept = 'FRANCE' GROUP BY 1 UNION ALL SELECT strftime(day, '%Y-%m'), CAST(sum(amount) AS DOUBLE) FROM visits WHERE strftime(day, '%Y-%m') NOT IN (SELECT strftime(day, '%Y-%m') FROM visits WHERE dept = 'FRANCE') GROUP BY 1")
def flt02_prefer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are totals already, where a period has them; else the sum of its rows. One pass."""
    total = F.col("dept") == "FRANCE"
    sums = visits(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum(F.when(total, F.col("amount"))).alias("given"), F.sum("amount").alias("summed"))
    return sums.select("month", F.coalesce("given", "summed").cast("double").alias("amount"))


@query("flt03_rooms", "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size % 3 = 0")
def flt03_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-22: by ward and normalised sex."""
    part = table(spark, sf_dir, "part").withColumn("sex", coerce.sex(F.when(F.col("p_size") % 3 == 0, " 여 ").otherwise("male")))
    ward = part.agg(F.min("p_brand").alias("p_brand"))
    return part.where("sex = 'F'").join(F.broadcast(ward), "p_brand", "left_semi").select("p_partkey")


@query("flt11_pending", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND lang <> 'fr'")
def flt11_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMS-08, CMS-15, CMS-02: what is pending and not deleted."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("indexed").alias("status"), (F.col("lang") == "fr").alias("is_deleted"))
    return embed.pending(chunks).select("doc_id")


@query(
    "flt15_filtered_search",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.label = 1),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d) SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5 AND distance <= 1.5""",
)
def flt15_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-21..RET-24, FLT-14: k of one kind first, then the limit of distance."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.vector_search(vectors.where("label = 1"), queries, 5)
    return found.where("distance <= 1.5").withColumn("distance", F.round("distance", 6))


@query("flt19_negative_questions", "SELECT conv_id, text FROM conversations WHERE role = 'user' AND conv_id % 4 = 0 ORDER BY conv_id DESC, turn DESC LIMIT 20")
def flt19_negative_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 questions with negative feedback (every fourth conversation stands for them)."""
    return table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 4 = 0").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "text")


@query("prj06_category", "SELECT doc_id, CASE WHEN source = 'src0' THEN 'regulation' ELSE 'manual' END AS category FROM documents")
def prj06_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", "regulation").otherwise("manual").alias("category"))


@query("prj08_schema_rows", "SELECT 'nation' AS \"table\", 0 AS position, 'n_nationkey' AS \"column\", 'int' AS type UNION ALL SELECT 'nation', 1, 'n_name', 'string' UNION ALL SELECT 'nation', 2, 'n_regionkey', 'int'")
def prj08_schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-02, PRJ-04, SRC-12..SRC-14, SRC-18, SRC-19: columns by Spark's own analysis."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return readers.catalog_columns(spark, ["nation"])


@query("src20_named_query", "SELECT n_regionkey, count(*) AS n, CAST(NULL AS VARCHAR) AS day FROM nation GROUP BY 1")
def src20_named_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20..SRC-26: a registry of queries by key; days are parameters."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("registry_nation")
    named = readers.NamedQueries({"regions": "SELECT n_regionkey, count(*) AS n, CAST(NULL AS STRING) AS day FROM registry_nation GROUP BY 1"}, {"regions": "SELECT n_regionkey, count(*) AS n, :d AS day FROM registry_nation GROUP BY 1"})
    return named.run(spark, "regions")


@query(
    "str09_at_break",
    """WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS head, reverse(substr(text, 1, 400)) AS back FROM documents),
    l AS (SELECT *, greatest(CASE WHEN contains(back, '.') THEN 401 - strpos(back, '.') ELSE 0 END, CASE WHEN contains(back, ' ') THEN 401 - strpos(back, ' ') ELSE 0 END, CASE WHEN contains(back, chr(10)) THEN 401 - strpos(back, chr(10)) ELSE 0 END) AS last FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN last > 280 THEN substr(head, 1, last) ELSE head END AS head FROM l""",
)
def str09_at_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 400 characters, for a pair scorer."""
    return table(spark, sf_dir, "documents").select("doc_id", text.at_break(F.col("text")).alias("head"))


@query("str18_card_numbers", "SELECT c_custkey, substr(lpad(CAST(c_custkey AS VARCHAR), 16, '4'), 1, 4) || '-****-****-' || substr(lpad(CAST(c_custkey AS VARCHAR), 16, '4'), 13, 4) AS card FROM customer")
def str18_card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.masked_card(F.lpad(F.col("c_custkey").cast("string"), 16, "4")).alias("card"))


@query("str15_follow_up", r"SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[*_#`>]', '', 'g'), '\s+', ' ', 'g')), 1, 80) AS query FROM conversations")
def str15_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question without marks of Markdown, 80 characters at most."""
    plain = F.regexp_replace(F.regexp_replace("text", r"[*_#`>]", ""), r"\s+", " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.trim(plain), 1, 80).alias("query"))


@query("arr01_lists", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role)))[1:2], ',') AS roles, count(*) AS turns FROM conversations GROUP BY 1")
def arr01_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.slice(F.sort_array(F.collect_set("role")), 1, 2), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("roles"), F.count("*").alias("turns"))


@query("etl16_examples", "SELECT item_id, md5('Q: ' || text || e'\\nSQL: SELECT ' || item_id) AS document FROM benchmark")
def etl16_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16, SNK-17: example questions as documents of an index, by their hashes."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.concat(F.lit("Q: "), "text", F.lit("\nSQL: SELECT "), F.col("item_id").cast("string"))).alias("document"))


@query("cms07_rollback", "SELECT doc_id, CASE WHEN source = 'src1' THEN CASE WHEN doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1') THEN 'active' ELSE 'deprecated' END ELSE 'active' END AS status FROM documents")
def cms07_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    version = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    registry = docs.select("doc_id", F.col("source").alias("title"), version.alias("version"), F.lit(lifecycle.ACTIVE).alias("status"))
    return lifecycle.rollback(registry, "src1", 1).select("doc_id", "status")


@query("ret26_admin_search", "SELECT doc_id, source, substr(text, 1, 60) AS head FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 40")
def ret26_admin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMS-16: a substring search whatever the case, the first 40 of a list on screen."""
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("tion"))).orderBy("doc_id").limit(40).select("doc_id", "source", F.substring("text", 1, 60).alias("head"))


@query("snk15_audit", "SELECT 'query' AS action, CAST(o_orderkey AS VARCHAR) AS target, 'analyst' AS actor, strftime(o_orderdate, '%Y-%m-%d') AS at FROM orders WHERE o_orderstatus = 'P'")
def snk15_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-09: the rows that an audit log gets."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(*lifecycle.audit("query", F.col("o_orderkey"), "analyst", F.date_format("o_orderdate", "yyyy-MM-dd")))


@query("flt12_not_deleted", "SELECT doc_id FROM documents WHERE lang <> 'fr'")
def flt12_not_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "fr", lifecycle.DELETED).otherwise(lifecycle.ACTIVE).alias("status"))
    return filters.equals_or_all(docs, "status", lifecycle.ACTIVE).select("doc_id")
