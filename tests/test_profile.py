import random

from pyspark.sql import functions as F

from millrace.operators import governance, profile


def test_sketches_of_days_merge_within_their_errors(spark):
    rng = random.Random(3)
    rows = [(d, rng.randrange(20_000), rng.expovariate(0.01), rng.choice("xyz")) for d in range(6) for _ in range(5000)]
    days = profile.day_profiles(spark.createDataFrame(rows, "day int, code long, price double, kind string"), F.col("day"))
    for span in (range(6), range(2, 4)):
        got = {r.name: r for r in profile.merged_profiles(days.where(F.col("day").isin(list(span)))).collect()}
        own = [r for r in rows if r[0] in span]
        assert got["kind"].distinct == 3 and not got["kind"].numeric and got["kind"].median is None and got["code"].n == len(own)
        codes = len({r[1] for r in own})
        assert abs(got["code"].distinct - codes) < 0.06 * codes
        prices = sorted(r[2] for r in own)
        for q, value in ((0.1, got["price"].low), (0.5, got["price"].median), (0.9, got["price"].high)):
            rank = sum(p <= value for p in prices) / len(prices)
            assert abs(rank - q) < 0.03
        assert (got["price"].least, got["price"].most) == (prices[0], prices[-1])


def test_grouping_sets_of_one_pass(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, "A B"), ("a", None, 2.0, "C D"), ("b", "x", None, "E F")], "p string, q string, m double, name string")
    got = sorted((r.dimension, r.value or "", r.n, r.total, r["mean"]) for r in profile.smart_aggregate(rows, ["p", "q"], ["m"]).collect())
    assert got == [("all", "", 2, 3.0, 1.5), ("p", "a", 2, 3.0, 1.5), ("p", "b", 0, None, None), ("q", "", 1, 2.0, 2.0), ("q", "x", 1, 1.0, 1.0)]
    plan = profile.smart_aggregate(rows, ["p", "q"], ["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    by, measures = profile.grouping(profile.merged_profiles(profile.day_profiles(rows, F.lit(1))), most_values=2)
    assert by == ["m", "p"] or set(by) == {"m", "p"} and measures == []


def test_reviews(spark):
    spark.sql("SELECT DATE '2024-01-01' AS d, TIMESTAMP '2024-01-01 00:00:00' AS t, 5 AS n, '20240101' AS s").createOrReplaceTempView("reviewed")
    access = governance.Access({"reviewed"})
    judge = lambda sql: governance.review(spark, sql, access)
    for sql in ("SELECT n FROM reviewed WHERE d >= '2024-01-01'", "SELECT trunc(d, 'MM') AS m FROM reviewed", "SELECT n FROM reviewed WHERE d IN ('2024-01-01', '2024-02-01') AND t > d", "SELECT n FROM reviewed WHERE s = '20240101'"):
        assert judge(sql).verdict == "ok", sql
    for sql in ("SELECT n FROM reviewed WHERE d = 'soon'", "SELECT n FROM reviewed WHERE n IN (SELECT n FROM reviewed WHERE d < 'never')", "SELECT date_trunc('DAY', n) AS m FROM reviewed", "SELECT n FROM reviewed WHERE d = 20240101"):
        assert judge(sql).verdict == "rejected", sql
    assert judge("SELECT x.n FROM hr.reviewed x JOIN hr.reviewed y ON x.n = y.n") == governance.Review("corrected", "", "SELECT x.n FROM reviewed x JOIN reviewed y ON x.n = y.n")
    assert judge("SELECT n FROM revewed").proposal == "reviewed" and judge("SELECT n FROM quite_another").proposal == ""
    assert judge("INSERT INTO reviewed SELECT 1").verdict == "rejected" and judge("SELECT 1").verdict in ("ok", "rejected")
