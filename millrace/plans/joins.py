"""Joins, windows, filters, sorts and set operations on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.operators import compare, filters, hierarchy, reconcile, topn
from millrace.plans.catalog import query
from millrace.plans.relational import DAY, VISITS, visits
from millrace.session import table


@query(
    "join01_left_three_keys",
    """SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, count(*) AS n, count(o.o_orderkey) AS matched FROM lineitem l
    LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey AND l.l_linenumber = length(o.o_orderpriority) - 3 GROUP BY 1, 2, 3""",
)
def join01_left_three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN-02, JOIN-16 and JOIN-18: left lookups."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    on = (line.l_orderkey == orders.o_orderkey) & (line.l_suppkey == orders.o_custkey) & (line.l_linenumber == F.length("o_orderpriority") - 3)
    return line.join(orders, on, "left").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("matched"))


@query(
    "join03_conditions_in_on",
    """SELECT c_custkey, n_name, r_name, count(o_orderkey) AS open_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1, 2, 3""",
)
def join03_conditions_in_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    places = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    open_ = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open_orders"))
    return places.join(open_, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", F.coalesce("open_orders", F.lit(0)).alias("open_orders"))


@query(
    "join04_four_way_counts",
    """SELECT n_name, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned, count(CASE WHEN l_quantity > 45 THEN 1 END) AS large
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def join04_four_way_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 45).alias("large"))


@query(
    "join06_prefix_join",
    """WITH k AS (SELECT substr(text, 1, 40) AS p, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT d.doc_id, k.first_id FROM documents d JOIN k ON substr(d.text, 1, 40) = k.p""",
)
def join06_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN-05: the first text with the probe's prefix, by an equi-join."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("first_id"), F.substring("text", 1, 40).alias("t"))
    return reconcile.prefix_match(texts, docs.select("doc_id", F.substring("text", 1, 40).alias("probe")), 40, "t", "probe", "first_id").select("doc_id", "first_id")


RECON = """ours AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders WHERE o_orderkey % 7 <> 0),
theirs AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN CAST(round(o_totalprice) AS BIGINT) + 1 WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END AS amount FROM orders WHERE o_orderkey % 5 <> 0),
b AS (SELECT coalesce(o.k, t.k) AS k, o.amount AS our_amount, t.amount AS their_amount FROM ours o FULL JOIN theirs t ON o.k = t.k),
s AS (SELECT *, CASE WHEN coalesce(our_amount, 0) <> 0 AND coalesce(their_amount, 0) <> 0 AND our_amount = their_amount THEN 'ok' WHEN coalesce(our_amount, 0) <> 0 AND coalesce(their_amount, 0) <> 0 THEN 'amount_diff'
WHEN coalesce(their_amount, 0) <> 0 THEN 'missing' WHEN coalesce(our_amount, 0) <> 0 THEN 'ours_only' ELSE 'empty' END AS status FROM b)"""


def _recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("amount"))
    changed = F.when(F.col("k") % 11 == 0, F.col("amount") + 1).when(F.col("k") % 13 == 0, 0).otherwise(F.col("amount"))
    return reconcile.reconcile(orders.where("k % 7 <> 0"), orders.where("k % 5 <> 0").withColumn("amount", changed), "k", "amount")


@query("join07_reconciliation", f"WITH {RECON} SELECT * FROM s")
def join07_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also MTH-08: the status of each pair of amounts."""
    return _recon(spark, sf_dir)


@query(
    "join07_match_rate",
    f"""WITH {RECON} SELECT count_if(status = 'ok') AS ok, count_if(status = 'missing') AS missing, count_if(status = 'amount_diff') AS amount_diff, count_if(status = 'ours_only') AS ours_only,
    round(count_if(status = 'ok') * 100.0::DOUBLE / greatest(count_if(status IN ('ok', 'missing', 'amount_diff')), 1), 1) AS match_rate_pct FROM s""",
)
def join07_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match_rate(_recon(spark, sf_dir))


@query(
    "join09_today_yesterday",
    """SELECT event_type, count_if(CAST(ts AS DATE) = DATE '2024-01-15') AS today, count_if(CAST(ts AS DATE) = DATE '2024-01-14') AS yesterday FROM events
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-14', DATE '2024-01-15') GROUP BY event_type""",
)
def join09_today_yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-14").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")))
    on = lambda d, name: F.count_if(F.to_date("ts") == F.lit(d).cast("date")).alias(name)
    return rows.groupBy("event_type").agg(on("2024-01-15", "today"), on("2024-01-14", "yesterday"))


@query(
    "join10_new_groups",
    f"""WITH {VISITS}, n AS (SELECT dept, count(*) AS n FROM visits WHERE day BETWEEN DATE '{DAY}' - 6 AND DATE '{DAY}' GROUP BY 1),
    b AS (SELECT dept, count(*) AS before FROM visits WHERE day BETWEEN DATE '{DAY}' - 13 AND DATE '{DAY}' - 7 GROUP BY 1)
    SELECT n.dept, n.n, coalesce(b.before, 0) AS before, CASE WHEN b.dept IS NULL THEN 'new' WHEN n.n > b.before THEN '▲' WHEN n.n < b.before THEN '▼' ELSE '─' END AS trend FROM n LEFT JOIN b ON n.dept = b.dept""",
)
def join10_new_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir)
    now = filters.trailing_days(rows, "day", DAY, 7).groupBy("dept").agg(F.count("*").alias("n"))
    before = filters.trailing_days(rows, "day", "1998-06-08", 7).groupBy("dept").agg(F.count("*").alias("was"))
    trend = F.when(F.col("was").isNull(), "new").otherwise(coerce.arrow(F.col("n") - F.col("was")))
    return now.join(before, "dept", "left").select("dept", "n", F.coalesce("was", F.lit(0)).alias("before"), trend.alias("trend"))


BEDS = """p AS (SELECT p_partkey AS bed, p_partkey // 4 AS room, CASE WHEN p_size % 3 = 0 THEN 'F' WHEN p_size % 3 = 1 THEN 'M' ELSE '' END AS sex, p_size > 25 AS taken FROM part)"""


@query(
    "join12_free_beds",
    f"""WITH {BEDS}, o AS (SELECT DISTINCT room FROM p WHERE taken AND sex = 'M'), s AS (SELECT DISTINCT room FROM p WHERE taken AND sex = 'F')
    SELECT p.bed, p.room, s.room IS NOT NULL AS same_sex FROM p LEFT JOIN s ON p.room = s.room WHERE NOT p.taken AND p.room NOT IN (SELECT room FROM o)""",
)
def join12_free_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN-13: same-sex rooms come first, the key of which is `same_sex`."""
    sexes = F.when(F.col("p_size") % 3 == 0, "F").when(F.col("p_size") % 3 == 1, "M").otherwise("")
    beds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bed"), F.floor(F.col("p_partkey") / 4).alias("room"), sexes.alias("sex"), (F.col("p_size") > 25).alias("taken"))
    free = reconcile.free_places(beds.where("NOT taken").select("bed", "room"), beds.where("taken"), "room", "sex", "F")
    return free.select("bed", "room", "same_sex").orderBy(F.desc("same_sex"), "bed")


@query("join14_lookup", f"WITH {VISITS}, u AS (SELECT ward, count(*) AS urgent FROM visits WHERE priority = '1-URGENT' GROUP BY 1) SELECT r_name AS ward, coalesce(urgent, 0) AS urgent FROM region LEFT JOIN u ON u.ward = r_name")
def join14_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = visits(spark, sf_dir).where("priority = '1-URGENT'").groupBy("ward").agg(F.count("*").alias("urgent"))
    wards = table(spark, sf_dir, "region").select(F.col("r_name").alias("ward"))
    return wards.join(urgent, "ward", "left").select("ward", F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query("join17_in_set", "SELECT c_custkey, c_name FROM customer WHERE split_part(c_name, '#', 2)[-1:] IN ('1', '3', '5')")
def join17_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.substring(F.element_at(F.split("c_name", "#"), -1), -1, 1).isin("1", "3", "5")).select("c_custkey", "c_name")


@query("join19_unregistered", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join19_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "join20_version_chain",
    """WITH RECURSIVE v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer),
    r AS (SELECT id, id AS root, 1 AS depth FROM v WHERE parent IS NULL OR parent NOT IN (SELECT id FROM v) UNION ALL SELECT v.id, r.root, r.depth + 1 FROM v JOIN r ON v.parent = r.id WHERE r.depth < 50) SELECT id, root, depth FROM r""",
)
def join20_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") - 1).alias("parent"))
    return hierarchy.chains(chain, "id", "parent", 50)


@query(
    "join21_children_lists",
    """SELECT n_name AS parent, count(*) AS n, array_to_string(list(s_name ORDER BY s_suppkey), ',') AS children FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def join21_children_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"])
    return joined.groupBy(F.col("n_name").alias("parent")).agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("children"))


@query("win02_keep_first", "SELECT doc_id, h FROM (SELECT doc_id, md5(substr(text, 1, 500)) AS h, row_number() OVER (PARTITION BY md5(substr(text, 1, 500)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def win02_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ETL-09 and the hash keys of STR-24. A minimum per hash, so no group is sorted."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.substring("text", 1, 500)).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query(
    "win03_trend_dedup",
    f"""WITH {VISITS}, t AS (SELECT day, dept, id, amount, dept = 'FRANCE' AS is_total FROM visits),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY is_total DESC, CASE WHEN is_total THEN -id ELSE id END) AS k FROM t) SELECT day, dept, id, CAST(amount AS DOUBLE) AS amount FROM r WHERE k = 1""",
)
def win03_trend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day the last row of the total if there is one, else the first row."""
    total = F.col("dept") == "FRANCE"
    first = filters.keep_first(visits(spark, sf_dir), [F.col("day")], [F.desc(total), F.when(total, -F.col("id")).otherwise(F.col("id"))])
    return first.select("day", "dept", "id", F.col("amount").cast("double").alias("amount"))


@query("win04_next_version", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) + 1 AS next_version FROM orders")
def win04_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("version"), (F.count("*").over(by) + 1).alias("next_version"))


@query(
    "win05_moving_mean",
    "SELECT event_id, user_id, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / (100 * count(value) OVER w), 8) AS moving_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
)
def win05_moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also STM-02."""
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    mean = F.sum(F.round(F.col("value") * 100).cast("long")).over(frame).cast("double") / (F.count("value").over(frame) * 100)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(mean, 8).alias("moving_mean"))


@query(
    "win06_last_seven",
    f"WITH {VISITS}, d AS (SELECT day, count(*) AS n FROM visits WHERE day < DATE '{DAY}' GROUP BY day ORDER BY day DESC LIMIT 7) SELECT * FROM d",
)
def win06_last_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT-17."""
    daily = visits(spark, sf_dir).where(F.col("day") < F.lit(DAY).cast("date")).groupBy("day").agg(F.count("*").alias("n"))
    return filters.last_days_before(daily, "day", DAY, 7)


@query("win07_share_in_group", f"WITH {VISITS}, s AS (SELECT ward, dept, count(*) AS n FROM visits GROUP BY 1, 2) SELECT ward, dept, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY ward), 4) AS share_pct FROM s")
def win07_share_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = visits(spark, sf_dir).groupBy("ward", "dept").agg(F.count("*").alias("n"))
    return compare.with_share(counts, "n", by=["ward"])


@query(
    "win09_deltas",
    f"""WITH {VISITS}, m AS (SELECT ward, strftime(day, '%Y-%m') AS month, count(*) AS n FROM visits GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY ward ORDER BY month) AS previous FROM m)
    SELECT ward, month, n, previous, n - coalesce(previous, n) AS change, CASE WHEN n > coalesce(previous, n) THEN '▲' WHEN n < coalesce(previous, n) THEN '▼' ELSE '─' END AS direction FROM l""",
)
def win09_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN-08: without a previous row the change is none."""
    monthly = visits(spark, sf_dir).groupBy("ward", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return compare.lagged(monthly, "month", "n", ["ward"])


@query("win10_room_groups", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS room_group, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) % 2 AS INTEGER) AS shade FROM part")
def win10_room_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", group.alias("room_group"), (group % 2).alias("shade"))


@query("win11_keep_newest", "SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 5")
def win11_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK-04: what a retention of five keeps."""
    newest = topn.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return newest.select("o_custkey", "o_orderkey", "rk")


@query("flt01_sentinel", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def flt01_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.equals_or_all(table(spark, sf_dir, "orders"), "o_orderpriority", filters.ALL)
    return filters.equals_or_all(rows, "o_orderstatus", "P").select("o_orderkey", "o_orderstatus")


@query("flt04_day", f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'")
def flt04_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.trailing_days(table(spark, sf_dir, "orders"), "o_orderdate", DAY, 1).select("o_orderkey")


@query("flt05_trailing_week", f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{DAY}' - 6 AND DATE '{DAY}'")
def flt05_trailing_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.trailing_days(table(spark, sf_dir, "orders"), "o_orderdate", DAY, 7).select("o_orderkey")


@query("flt06_around", f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{DAY}' - 2 AND DATE '{DAY}' + 2")
def flt06_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.around(table(spark, sf_dir, "orders"), "o_orderdate", DAY, 2).select("o_orderkey")


@query("flt07_period_and_dept", f"WITH {VISITS} SELECT id, day FROM visits WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND dept = 'FRANCE'")
def flt07_period_and_dept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).where("day BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND dept = 'FRANCE'").select("id", "day")


@query("flt08_previous_period", f"WITH {VISITS} SELECT dept, count(*) AS n FROM visits WHERE day >= DATE '{DAY}' - 60 AND day < DATE '{DAY}' - 30 GROUP BY dept")
def flt08_previous_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(DAY).cast("date")
    return visits(spark, sf_dir).where((F.col("day") >= F.date_sub(day, 60)) & (F.col("day") < F.date_sub(day, 30))).groupBy("dept").agg(F.count("*").alias("n"))


@query("flt09_document_page", "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND text LIKE '%the%' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def flt09_document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("text").contains("the"))
    return filters.page(docs, [F.desc("n_chars"), F.col("doc_id")], 20, 2).select("doc_id", "source", "lang")


@query("flt10_tags", "SELECT doc_id FROM documents WHERE lower(lang) IN ('fr', 'de') AND contains(lower(text), 'en')")
def flt10_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(filters.has_any_tag(F.array("lang", "source"), ["FR", "De"]) & F.lower("text").contains("en")).select("doc_id")


@query("flt16_status_cap", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderkey LIMIT 500")
def flt16_status_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of a report on screen."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(500)


@query("flt18_retention", "SELECT event_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-10'")
def flt18_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also STM-03."""
    return filters.retained(table(spark, sf_dir, "events"), "ts", "2024-01-30", 20).select("event_id")


@query(
    "srt01_custom_order",
    """SELECT n_name, CAST(CASE n_name WHEN 'FRANCE' THEN 1 WHEN 'CHINA' THEN 2 ELSE 23 END AS INTEGER) AS place, CAST(row_number() OVER (ORDER BY CASE n_name WHEN 'FRANCE' THEN 1 WHEN 'CHINA' THEN 2 ELSE 23 END, n_name) AS INTEGER) AS rk FROM nation""",
)
def srt01_custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRT-02: listed departments first, others by name."""
    return topn.listed_first(table(spark, sf_dir, "nation").select("n_name"), "n_name", ["FRANCE", "CHINA"], 23)


@query("srt03_total_last", "SELECT r_name AS dept, n, 1 AS place FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) UNION ALL SELECT 'TOTAL', count(*), 99 FROM nation")
def srt03_total_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SET-01: details and their total, which is last."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).rollup("r_name").agg(F.grouping("r_name").alias("g"), F.count("*").alias("n"))
    total = F.col("g") == 1
    return counts.select(F.when(total, "TOTAL").otherwise(F.col("r_name")).alias("dept"), "n", F.when(total, 99).otherwise(1).alias("place")).orderBy("place", "dept")


@query("srt05_row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def srt05_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRT-09 and SRT-10: a top list, kept per partition before the merge."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("set02_key_union", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set02_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(
    "set03_concat_distinct",
    """WITH u AS (SELECT 1 AS q, item_id AS r, text FROM benchmark UNION ALL SELECT 2, doc_id, text FROM documents), f AS (SELECT q, r, substr(text, 1, 80) AS head, row_number() OVER (PARTITION BY substr(text, 1, 80) ORDER BY q, r) AS k FROM u)
    SELECT q, r, head FROM f WHERE k = 1 ORDER BY q, r LIMIT 15""",
)
def set03_concat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SET-06: hits of several queries in order, distinct by their first 80 characters, 15 at most."""
    hits = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("q"), F.col("item_id").alias("r"), "text").unionByName(table(spark, sf_dir, "documents").select(F.lit(2).alias("q"), F.col("doc_id").alias("r"), "text"))
    first = hits.groupBy(F.substring("text", 1, 80).alias("head")).agg(F.min(F.struct("q", "r")).alias("at"))
    return first.select("at.q", "at.r", "head").orderBy("q", "r").limit(15)


@query("set05_choices", "SELECT '전체' AS choice, 0 AS place UNION ALL SELECT DISTINCT c_mktsegment, 1 FROM customer")
def set05_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("choice"), F.lit(1).alias("place")).distinct()
    return spark.range(1).select(F.lit(filters.ALL).alias("choice"), F.lit(0).alias("place")).unionByName(choices).orderBy("place", "choice")
