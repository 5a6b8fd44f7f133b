"""Dashboard-style relational queries on the synthetic tables.

Departments are nations, wards are regions, insurances are market segments, days are order dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.operators import compare, cubes, filters, reconcile, topn
from millrace.plans.catalog import query
from millrace.session import table

DAY = "1998-06-15"

VISITS = """
visits AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, n_name AS dept, r_name AS ward, c_mktsegment AS insurance, o_orderstatus AS status,
                  o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its day, department, ward, insurance, status and amount; nation and region are small and of fixed size."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("dept"), F.col("r_name").alias("ward"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), "dept", "ward", F.col("c_mktsegment").alias("insurance"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), coerce.money(F.col("o_totalprice")).alias("amount"))


def _d(c: str, digits: int = 2):
    return F.round(F.col(c).cast("double"), digits).alias(c)


@query(
    "agg05_top8_other",
    f"""WITH {VISITS}, v AS (SELECT dept AS grp, sum(amount) AS value FROM visits GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, grp) AS rk FROM v),
    f AS (SELECT CASE WHEN rk <= 8 THEN grp ELSE 'OTHER' END AS grp, sum(value) AS value FROM r GROUP BY 1)
    SELECT grp, CAST(value AS DOUBLE) AS value, round(CAST(value AS DOUBLE) * 100 / CAST((SELECT sum(value) FROM v) AS DOUBLE), 4) AS share_pct FROM f""",
)
def agg05_top8_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_with_other(visits(spark, sf_dir), "dept", "amount", 8)


@query(
    "agg06_top10_other",
    """WITH v AS (SELECT p_brand AS grp, sum(CAST(l_quantity AS DECIMAL(18,2))) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, grp) AS rk FROM v),
    f AS (SELECT CASE WHEN rk <= 10 THEN grp ELSE 'OTHER' END AS grp, sum(value) AS value FROM r GROUP BY 1)
    SELECT grp, CAST(value AS DOUBLE) AS value, round(CAST(value AS DOUBLE) * 100 / CAST((SELECT sum(value) FROM v) AS DOUBLE), 4) AS share_pct FROM f""",
)
def agg06_top10_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return topn.top_with_other(lineitem.join(part, lineitem.l_partkey == part.p_partkey), "p_brand", "l_quantity", 10)


@query(
    "agg01_day_totals",
    f"""WITH {VISITS} SELECT strftime(day, '%Y-%m') AS month, CASE WHEN grouping(dept) = 1 THEN 'TOTAL' ELSE dept END AS dept, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
    FROM visits GROUP BY GROUPING SETS ((1, dept), (1))""",
)
def agg01_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = visits(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    return cubes.with_total(monthly, ["month", "dept"], {"n": F.count("*"), "amount": F.sum("amount").cast("double")})


@query(
    "agg02_occupancy",
    """SELECT r_name AS ward, count(*) AS beds, count_if(c_acctbal > 0) AS occupied, sum(CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END)::BIGINT AS free,
    round(count_if(c_acctbal > 0) * 100.0::DOUBLE / greatest(count(*), 1), 1) AS occupancy_pct
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def agg02_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wards = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    taken = F.count_if(F.col("c_acctbal") > 0)
    sums = wards.groupBy(F.col("r_name").alias("ward")).agg(F.count("*").alias("beds"), taken.alias("occupied"), F.sum(F.when(F.col("c_acctbal") > 0, 0).otherwise(1)).alias("free"))
    return sums.withColumn("occupancy_pct", coerce.ratio_pct(F.col("occupied"), F.col("beds")))


@query("agg04_group_sum", f"WITH {VISITS} SELECT ward, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM visits GROUP BY ward")
def agg04_group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).groupBy("ward").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))


@query(
    "agg07_cube",
    f"""WITH {VISITS} SELECT CASE WHEN grouping(ward) = 1 THEN 'TOTAL' ELSE ward END AS ward, CASE WHEN grouping(status) = 1 THEN 'TOTAL' ELSE status END AS status,
    CASE WHEN grouping(insurance) = 1 THEN 'TOTAL' ELSE insurance END AS insurance, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM visits GROUP BY CUBE (ward, status, insurance)""",
)
def agg07_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.cube(visits(spark, sf_dir), ["ward", "status", "insurance"], {"n": F.count("*"), "amount": F.sum("amount").cast("double")})


@query(
    "agg08_fallback_sum",
    f"""WITH {VISITS} SELECT dept, coalesce(nullif(CAST(sum(CASE WHEN status = 'P' THEN amount END) AS DOUBLE), 0), CAST(sum(amount) AS DOUBLE)) AS amount FROM visits GROUP BY dept""",
)
def agg08_fallback_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.nullif(F.sum(F.when(F.col("status") == "P", F.col("amount"))).cast("double"), F.lit(0.0))
    return visits(spark, sf_dir).groupBy("dept").agg(F.coalesce(first, F.sum("amount").cast("double")).alias("amount"))


@query(
    "agg09_status_pivot",
    f"""WITH {VISITS}, d AS (SELECT DISTINCT day FROM visits ORDER BY day DESC LIMIT 7)
    SELECT day, count_if(status = 'F') AS F, count_if(status = 'O') AS O, count_if(status = 'P') AS P FROM visits WHERE day IN (SELECT day FROM d) GROUP BY day""",
)
def agg09_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = cubes.pivot(visits(spark, sf_dir), "day", "status", ["F", "O", "P"], F.count(F.lit(1)))
    return daily.orderBy(F.desc("day")).limit(7)


@query(
    "agg10_heatmap",
    f"""WITH {VISITS}, l AS (SELECT dept, priority, last(amount ORDER BY day, id) AS amount FROM visits GROUP BY dept, priority)
    SELECT dept, """ + ", ".join(f"""coalesce(max(CASE WHEN priority = '{p}' THEN CAST(amount AS DOUBLE) END), 0) AS "{p}\"""" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM l GROUP BY dept",
)
def agg10_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = cubes.last_wins(visits(spark, sf_dir), ["dept", "priority"], [F.col("day"), F.col("id")], "amount")
    return cubes.pivot(last, "dept", "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], F.max(F.col("amount").cast("double")))


LOS = "CASE WHEN l_quantity >= 40 THEN '40+' WHEN l_quantity >= 20 THEN '20-39' WHEN l_quantity >= 10 THEN '10-19' ELSE '0-9' END"


@query("agg11_length_bins", f"SELECT {LOS} AS bin, min(CAST(floor(l_quantity / 10) AS BIGINT)) AS bin_order, count(*) AS n FROM lineitem GROUP BY 1")
def agg11_length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = coerce.band(F.col("l_quantity"), (40, "40+"), (20, "20-39"), (10, "10-19"), otherwise="0-9")
    return table(spark, sf_dir, "lineitem").groupBy(bins.alias("bin")).agg(F.min(F.floor(F.col("l_quantity") / 10)).alias("bin_order"), F.count("*").alias("n"))


@query(
    "agg12_long_stays",
    f"""WITH b AS (SELECT l_returnflag AS dept, {LOS} AS bin FROM lineitem) SELECT dept, count(*) AS n FROM b WHERE regexp_matches(bin, '40|20') GROUP BY dept ORDER BY n DESC, dept LIMIT 3""",
)
def agg12_long_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = coerce.band(F.col("l_quantity"), (40, "40+"), (20, "20-39"), (10, "10-19"), otherwise="0-9")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dept"), bins.alias("bin")).where(F.col("bin").rlike("40|20"))
    return rows.groupBy("dept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dept").limit(3)


NOW, BEFORE = "strftime(day, '%Y-%m') = '1998-05'", "strftime(day, '%Y-%m') = '1998-04'"
TWO = f"""t AS (SELECT dept AS grp, coalesce(sum(CASE WHEN {NOW} THEN amount END), 0) AS now_value, coalesce(sum(CASE WHEN {BEFORE} THEN amount END), 0) AS before_value
FROM visits WHERE {NOW} OR {BEFORE} GROUP BY dept),
c AS (SELECT grp, CAST(now_value AS DOUBLE) AS now_value, CAST(before_value AS DOUBLE) AS before_value, CAST(now_value - before_value AS DOUBLE) AS change,
CASE WHEN before_value = 0 THEN 0.0::DOUBLE ELSE round((CAST(now_value AS DOUBLE) - CAST(before_value AS DOUBLE)) * 100.0::DOUBLE / CAST(before_value AS DOUBLE), 1) END AS growth_pct,
CASE WHEN now_value > before_value THEN '▲' WHEN now_value < before_value THEN '▼' ELSE '─' END AS direction FROM t)"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("day", "yyyy-MM")
    out = compare.two_periods(visits(spark, sf_dir), "dept", F.col("amount"), month == "1998-05", month == "1998-04")
    return out.select("grp", *(F.col(c).cast("double").alias(c) for c in ("now_value", "before_value", "change")), "growth_pct", "direction")


@query("agg13_month_comparison", f"WITH {VISITS}, {TWO} SELECT * FROM c")
def agg13_month_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN-08 and WIN-08: every group of either month, zero-filled, with change and direction."""
    return _months(spark, sf_dir)


@query("join11_month_anomalies", f"WITH {VISITS}, {TWO} SELECT * FROM c WHERE before_value > 10 AND abs(growth_pct) >= 30 ORDER BY abs(growth_pct) DESC, grp LIMIT 5")
def join11_month_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.anomalies(_months(spark, sf_dir), 10, 30, 5)


@query(
    "agg14_dependency",
    f"""WITH {VISITS}, s AS (SELECT ward, sum(amount) AS amount FROM visits GROUP BY ward), x AS (SELECT ward, CAST(amount AS DOUBLE) AS amount, round(CAST(amount AS DOUBLE) * 100 / CAST(sum(amount) OVER () AS DOUBLE), 4) AS share_pct FROM s)
    SELECT ward, amount, share_pct, CASE WHEN share_pct >= 60 THEN 'risk' WHEN share_pct >= 40 THEN 'caution' ELSE 'ok' END AS level FROM x ORDER BY amount DESC, ward LIMIT 1""",
)
def agg14_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = visits(spark, sf_dir).groupBy(F.col("ward").alias("grp")).agg(F.sum("amount").alias("amount"))
    return compare.dependency(sums, "amount").select(F.col("grp").alias("ward"), F.col("amount").cast("double").alias("amount"), "share_pct", "level")


@query(
    "agg15_region_month_matrix",
    f"""WITH {VISITS}, t AS (SELECT dept FROM visits GROUP BY dept ORDER BY count(*) DESC, dept LIMIT 5)
    SELECT dept, strftime(day, '%Y-%m') AS month, count(*) AS n FROM visits WHERE dept IN (SELECT dept FROM t) GROUP BY 1, 2""",
)
def agg15_region_month_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir)
    counts = rows.groupBy("dept", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    top = counts.groupBy("dept").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "dept").limit(5).select("dept")
    return counts.join(F.broadcast(top), "dept", "left_semi")


@query(
    "agg16_monthly_top3",
    f"""WITH {VISITS}, m AS (SELECT strftime(day, '%Y-%m') AS month, dept, count(*) AS n FROM visits GROUP BY 1, 2)
    SELECT month, dept, n, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY n DESC, dept) AS INTEGER) AS rk FROM m) WHERE rk <= 3""",
)
def agg16_monthly_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = visits(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month"), "dept").agg(F.count("*").alias("n"))
    return topn.top_per_group(counts, ["month"], [F.desc("n"), F.col("dept")], 3)


@query(
    "agg17_district_share",
    """WITH s AS (SELECT split_part(c_name, '#', 2)[-1:] AS district, count(*) AS n FROM customer GROUP BY 1) SELECT district, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS share_pct FROM s""",
)
def agg17_district_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy(F.substring(F.element_at(F.split("c_name", "#"), 2), -1, 1).alias("district")).agg(F.count("*").alias("n"))
    return compare.with_share(counts, "n")


AGE = "CASE WHEN p_size >= 40 THEN '40+' WHEN p_size < 10 THEN '0-9' ELSE CAST(CAST(floor(p_size / 10) * 10 AS INTEGER) AS VARCHAR) || '-' END"


@query("agg18_decades_by_brand", f"SELECT p_brand AS dept, {AGE} AS decade, count(*) AS n FROM part GROUP BY 1, 2")
def agg18_decades_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens = F.concat((F.floor(F.col("p_size") / 10) * 10).cast("int").cast("string"), F.lit("-"))
    decade = F.when(F.col("p_size") >= 40, "40+").when(F.col("p_size") < 10, "0-9").otherwise(tens)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dept"), decade.alias("decade")).agg(F.count("*").alias("n"))


@query("agg19_status_counts", "SELECT count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'O') AS open, count_if(o_orderstatus = 'P') AS pending, count(*) AS n FROM orders")
def agg19_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-21: done and pending."""
    n = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return table(spark, sf_dir, "orders").agg(n("F", "done"), n("O", "open"), n("P", "pending"), F.count("*").alias("n"))


@query(
    "agg20_risk_ranking",
    f"""WITH {VISITS}, s AS (SELECT dept, count(*) AS census, count_if(priority = '1-URGENT') AS urgent, count_if(priority = '2-HIGH') AS high, count_if(priority = '5-LOW') AS low FROM visits GROUP BY dept),
    u AS (SELECT dept, census, 'urgent' AS risk, urgent AS n FROM s UNION ALL SELECT dept, census, 'high', high FROM s UNION ALL SELECT dept, census, 'low', low FROM s)
    SELECT risk, dept, n, rk, round(n * 100.0::DOUBLE / greatest(census, 1), 1) AS census_pct FROM (SELECT *, CAST(row_number() OVER (PARTITION BY risk ORDER BY n DESC, dept) AS INTEGER) AS rk FROM u) WHERE rk <= 8""",
)
def agg20_risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p, name: F.count_if(F.col("priority") == p).alias(name)
    sums = visits(spark, sf_dir).groupBy("dept").agg(F.count("*").alias("census"), n("1-URGENT", "urgent"), n("2-HIGH", "high"), n("5-LOW", "low"))
    long = sums.unpivot(["dept", "census"], ["urgent", "high", "low"], "risk", "n")
    return topn.top_per_group(long, ["risk"], [F.desc("n"), F.col("dept")], 8).select("risk", "dept", "n", "rk", coerce.ratio_pct(F.col("n"), F.col("census")).alias("census_pct"))


@query(
    "agg22_finance_today",
    f"""WITH {VISITS} SELECT insurance, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n, round(CAST(sum(amount) AS DOUBLE) * 100 / 50000000, 2) AS goal_pct FROM visits WHERE status = 'F' GROUP BY insurance""",
)
def agg22_finance_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-41: revenue against a goal."""
    paid = visits(spark, sf_dir).where("status = 'F'").groupBy("insurance").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))
    return paid.withColumn("goal_pct", F.round(F.try_divide(F.col("amount") * 100, F.lit(50_000_000)), 2))


@query(
    "agg23_overdue",
    f"""WITH {VISITS}, s AS (SELECT insurance, sum(amount) AS amount, count(*) AS n FROM visits WHERE status = 'O' GROUP BY insurance)
    SELECT CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(n) AS BIGINT) AS n, (SELECT insurance FROM s ORDER BY amount DESC, insurance LIMIT 1) AS largest FROM s""",
)
def agg23_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = visits(spark, sf_dir).where("status = 'O'").groupBy("insurance").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("amount"), "insurance"))  # a row for each insurance
    return sums.withColumn("rk", rank).agg(F.sum("amount").cast("double").alias("amount"), F.sum("n").alias("n"), F.min_by("insurance", "rk").alias("largest"))


@query(
    "agg24_chart_builder",
    """WITH g AS (SELECT event_type, count(*) AS n, avg(CAST(value AS DECIMAL(18,4))) AS mean FROM events WHERE event_type IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS ratio_pct, round(CAST(mean AS DOUBLE), 3) AS mean FROM g""",
)
def agg24_chart_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isNotNull())
    sums = rows.groupBy("event_type").agg(F.count("*").alias("n"), (F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")).alias("mean"))
    return compare.with_share(sums, "n", "ratio_pct", digits=2).select("event_type", "n", "ratio_pct", F.round("mean", 3).alias("mean"))


@query(
    "agg26_histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT CAST(floor((o_totalprice - lo) / ((hi - lo) / 10)) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1""",
)
def agg26_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10)


@query(
    "agg27_numeric_summary",
    """SELECT 'l_quantity' AS name, count(l_quantity) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem
    UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), min(l_extendedprice), max(l_extendedprice) FROM lineitem""",
)
def agg27_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice"]
    long = table(spark, sf_dir, "lineitem").select(*names).unpivot([], names, "name", "x")
    return long.groupBy("name").agg(F.count("x").alias("n"), F.sum(coerce.money(F.col("x"))).cast("double").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))


@query(
    "agg28_mode_stats",
    """WITH s AS (SELECT event_type AS mode, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT mode, n, v[least(CAST(floor(n * 0.5) AS INTEGER) + 1, n)] AS p50, v[least(CAST(floor(n * 0.9) AS INTEGER) + 1, n)] AS p90 FROM s""",
)
def agg28_mode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles, from ranks rather than from a list of a whole group."""
    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select(F.col("event_type").alias("mode"), "value")
    return topn.nearest_rank(rows, "mode", "value", {"p50": 0.5, "p90": 0.9})


@query(
    "agg30_benchmark_hits",
    """WITH m AS (SELECT d.lang AS category, l.quality AS mode, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT CASE WHEN grouping(mode) = 1 THEN -1 ELSE mode END AS mode, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, count_if(toxic = 1) AS hits, round(count_if(toxic = 1) / count(*), 3) AS precision
    FROM m GROUP BY GROUPING SETS ((mode, category), (mode), ())""",
)
def agg30_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-31: rates by mode and in total."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    rolled = labels.join(docs, "doc_id").rollup("quality", "category").agg(F.grouping("quality").alias("gm"), F.grouping("category").alias("gc"), F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("hits"))
    mode = F.when(F.col("gm") == 1, -1).otherwise(F.col("quality")).alias("mode")
    return rolled.select(mode, F.when(F.col("gc") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n", "hits", F.round(F.col("hits") / F.col("n"), 3).alias("precision"))


@query(
    "agg32_statistics",
    "SELECT count(*) AS documents, count(DISTINCT md5(text)) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters, count_if(lang = 'en') AS english FROM documents",
)
def agg32_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-35: index statistics."""
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("documents"), F.count_distinct(F.md5("text")).alias("texts"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("lang") == "en").alias("english"))


@query("agg33_by_category", "SELECT lang AS category, count(*) AS n, round(sum(n_chars) / 1048576, 3) AS mb FROM documents GROUP BY lang")
def agg33_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-37."""
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("n_chars") / 1048576, 3).alias("mb"))


@query(
    "agg34_chunks_per_source",
    "SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS characters, coalesce(min(CASE WHEN doc_id > 0 THEN doc_id END), 0) AS first_page, coalesce(max(CASE WHEN doc_id > 0 THEN doc_id END), 0) AS last_page, max(lang) AS type FROM documents GROUP BY source",
)
def agg34_chunks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG-36."""
    paged = F.when(F.col("doc_id") > 0, F.col("doc_id"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("chunks"), F.sum("n_chars").alias("characters"), F.coalesce(F.min(paged), F.lit(0)).alias("first_page"), F.coalesce(F.max(paged), F.lit(0)).alias("last_page"), F.max("lang").alias("type"))


@query(
    "agg38_click_share",
    """WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), x AS (SELECT user_id, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS share_pct FROM s) SELECT * FROM x ORDER BY n DESC, user_id LIMIT 8""",
)
def agg38_click_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return compare.with_share(counts, "n").orderBy(F.desc("n"), "user_id").limit(8)


@query(
    "agg39_error_rate",
    """SELECT event_type, count(*) AS n, count_if(value < 10) AS errors, round(count_if(value < 10) * 100.0::DOUBLE / greatest(count(*), 1), 1) AS error_pct,
    CASE WHEN round(count_if(value < 10) * 100.0::DOUBLE / greatest(count(*), 1), 1) >= 10 THEN 'high' WHEN round(count_if(value < 10) * 100.0::DOUBLE / greatest(count(*), 1), 1) >= 5 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY 1""",
)
def agg39_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 10).alias("errors"))
    rate = sums.withColumn("error_pct", coerce.ratio_pct(F.col("errors"), F.col("n")))
    return rate.withColumn("level", coerce.band(F.col("error_pct"), (10, "high"), (5, "medium"), otherwise="low"))


@query(
    "agg40_pipeline_stages",
    f"WITH {VISITS} SELECT ward, count_if(status = 'O') AS admitted, count_if(status = 'P') AS leaving, count_if(status = 'F') AS gone FROM visits GROUP BY ward",
)
def agg40_pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cubes.pivot(visits(spark, sf_dir), "ward", "status", ["O", "P", "F"], F.count(F.lit(1)))
    return counts.withColumnsRenamed({"O": "admitted", "P": "leaving", "F": "gone"})


@query(
    "agg42_kiosk_share",
    f"""WITH {VISITS}, s AS (SELECT dept, count_if(priority = '1-URGENT') AS kiosk, count(*) AS n FROM visits GROUP BY dept) SELECT dept, kiosk, n, CAST(floor(kiosk * 100 / greatest(n, 1) + 0.5) AS BIGINT) AS kiosk_pct FROM s ORDER BY n DESC, dept LIMIT 15""",
)
def agg42_kiosk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = visits(spark, sf_dir).groupBy("dept").agg(F.count_if(F.col("priority") == "1-URGENT").alias("kiosk"), F.count("*").alias("n"))
    return sums.withColumn("kiosk_pct", F.floor(F.col("kiosk") * 100 / F.greatest("n", F.lit(1)) + 0.5).cast("long")).orderBy(F.desc("n"), "dept").limit(15)


@query(
    "agg43_context_json",
    f"""WITH {VISITS}, s AS (SELECT ward, count(*) AS n, count_if(status = 'O') AS open FROM visits GROUP BY ward) SELECT ward, '{{"ward":"' || ward || '","n":' || n || ',"open":' || open || '}}' AS context FROM s""",
)
def agg43_context_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JSN-01: aggregates as text for a prompt, at most 6000 characters."""
    sums = visits(spark, sf_dir).groupBy("ward").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "O").alias("open"))
    return sums.select("ward", F.substring(F.to_json(F.struct("ward", "n", "open")), 1, 6000).alias("context"))
