import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import cubes, filters, governance, hierarchy, lifecycle, profile, reconcile, retrieval
from millrace.sources import readers, sinks
from millrace.streaming import events

ATTACKS = [
    "", "DELETE FROM seen", "DROP TABLE seen", "INSERT INTO seen VALUES (1)", "SELECT 1", "SELECT 1; DROP TABLE seen", "SELECT * FROM hidden", "SELECT * FROM seen, hidden", "SELECT * FROM seen JOIN hidden ON true",
    "WITH x AS (SELECT * FROM seen) SELECT * FROM x", "SELECT * FROM seen WHERE id IN (SELECT id FROM hidden)", "SELECT (SELECT max(id) FROM hidden) FROM seen", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM other.seen",
    "SELECT * FROM (SELECT * FROM hidden)", "SELECT * FROM seen UNION SELECT * FROM hidden", "SELECT nothing FROM seen", "CREATE TABLE t AS SELECT * FROM seen", "SELECT * FROM seen WHERE EXISTS (SELECT 1 FROM hidden)", "SELECT * FROM range(10)",
]


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(i, f"Name {i}") for i in range(20)], "id long, name string").createOrReplaceTempView("seen")
    spark.range(5).createOrReplaceTempView("hidden")
    return governance.Access({"seen"}, max_rows=7)


@pytest.mark.parametrize("sql", ATTACKS)
def test_attacks_are_rejected(spark, views, sql):
    with pytest.raises(governance.Rejected):
        governance.guarded(spark, sql, views)


def test_good_statements_run(spark, views):
    rows = governance.guarded(spark, "```sql\nSELECT id, name, 'DELETE' AS word FROM seen -- DROP\n;```", views).collect()
    assert len(rows) == 7 and rows[0].name.startswith("N***") and rows[0].word == "DELETE"
    assert governance.guarded(spark, "SELECT count(*) AS n FROM seen WHERE id < :most", views, {"most": 5}).first().n == 5
    assert "- id (bigint): key" in governance.schema_text(spark, ["seen"], {"seen.id": "key"})


def test_profile(spark):
    df = spark.createDataFrame([(f"202401{i:02d}", f"{i % 24:02d}30", i * 1.5, "ab"[i % 2], f"text {i}") for i in range(1, 29)], "d8 string, at string, x double, kind2 string, words string")
    found = profile.roles(df)
    assert found == {"d8": "date", "at": "time", "x": "numeric", "kind2": "category", "words": "text"}
    assert profile.chart(df, found) == "line" and profile.chart(df.select("kind2", "x")) == "pie"
    assert profile.intent("how many", 1, found) == "KPI" and profile.intent("list of all", 50, found) == "LIST"
    assert profile.roles(df.limit(0)).keys() == found.keys()


def test_lifecycle(spark):
    schema = "doc_id long, title string, category string, file_hash string, created_at long"
    empty = spark.createDataFrame([], schema + ", version int, status string")
    one = lifecycle.upload(empty, spark.createDataFrame([(1, "t", "c", "h1", 1), (2, "t", "c", "h1", 2), (3, "u", "c", "h3", 1)], schema))
    assert sorted((r.doc_id, r.version, r.status) for r in one.collect()) == [(1, 1, "active"), (3, 1, "active")]
    two = lifecycle.upload(one, spark.createDataFrame([(4, "t", "c", "h4", 5), (5, "t", "c", "h1", 6)], schema))
    assert sorted((r.doc_id, r.version, r.status) for r in two.collect()) == [(1, 1, "deprecated"), (3, 1, "active"), (4, 2, "active")]
    back = lifecycle.rollback(two, "t", 1)
    assert {r.doc_id: r.status for r in back.collect()} == {1: "active", 3: "active", 4: "deprecated"}
    assert {r.doc_id: r.status for r in lifecycle.rollback(two, "t", 9).collect()}[4] == "active"
    chunks = spark.createDataFrame([(1, "a", "indexed", False)], "doc_id long, content string, status string, is_deleted boolean")
    changed = lifecycle.replace_chunks(chunks, 1, spark.createDataFrame([(1, "b")], "doc_id long, content string")).collect()
    assert sorted((r.content, r.is_deleted) for r in changed) == [("a", True), ("b", False)]
    only = spark.createDataFrame([("s",)], "source string")
    assert lifecycle.without_source(only, "s").count() == 1


def test_chains_with_a_cycle(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id long, parent long")
    assert sorted(tuple(r) for r in hierarchy.chains(rows, "id", "parent").collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]


def test_reconciliation_edges(spark):
    ours = spark.createDataFrame([("a", 5), ("b", 0), ("c", 1), ("d", 2)], "k string, amount long")
    theirs = spark.createDataFrame([("a", 5), ("b", 3), ("d", 9), ("e", 4)], "k string, amount long")
    status = reconcile.reconcile(ours, theirs, "k", "amount")
    assert {r.k: r.status for r in status.collect()} == {"a": "ok", "b": "missing", "c": "ours_only", "d": "amount_diff", "e": "missing"}
    assert reconcile.match_rate(status).first().match_rate_pct == 25.0
    cards = spark.createDataFrame([("1", 1, 10), ("1", 2, 20), ("", 3, 5), (None, 4, 5)], "no string, seq int, amount int")
    assert [r.amount for r in reconcile.last_per_key(cards, "no", "seq").collect()] == [20]


def test_rooms(spark):
    free = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3"), (4, "r4")], "bed int, room string")
    taken = spark.createDataFrame([("r1", "F"), ("r2", "M"), ("r3", "")], "room string, sex string")
    assert sorted((r.bed, r.same_sex) for r in reconcile.free_places(free, taken, "room", "sex", "F").collect()) == [(1, True), (3, False), (4, False)]


def test_histogram_ends(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    assert {r.bin: r.n for r in cubes.histogram(df, "x").collect()} == {i: 1 for i in range(11)}
    assert [(r.bin, r.n) for r in cubes.histogram(df.where("x = 1"), "x").collect()] == [(0, 1)]


def test_retention_keeps_unreadable(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-30",), ("soon",), (None,)], "ts string")
    assert sorted(str(r.ts) for r in filters.retained(df, "ts", "2024-01-31", 5).collect()) == ["2024-01-30", "None", "soon"]


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "aa cc"), (3, "aa"), (4, "")], "doc_id long, text string")
    hits = retrieval.bm25(docs, spark.createDataFrame([(1, "bb bb zz"), (2, "aa")], "query_id long, text string"), 5).collect()
    idf, mean_dl = math.log((4 - 1 + 0.5) / 1.5), 6 / 4
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean_dl))
    assert [(r.id, r.score) for r in hits if r.query_id == 1] == [(1, pytest.approx(want, abs=1e-6))]
    assert [r.id for r in hits if r.query_id == 2] == [3, 2, 1]  # a term of most documents still counts, by the floor of its weight


def test_fusion_and_fallback(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    fused = retrieval.fuse([a, b], 5)
    assert [r.id for r in fused.orderBy("rank").collect()] == [11, 10, 12]
    assert [r.id for r in retrieval.fallback_order(fused, 1).collect()] == [11]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "timestamp": "2024-01-01"}\nbroken\n{"id": 2, "timestamp": "2024-01-02"}\n')
    assert [r.id for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id long, timestamp string", "timestamp").where("id IS NOT NULL").collect()] == [2, 1]
    (tmp_path / "r.json").write_text(json.dumps({"d1": {"title": "x"}, "d2": {"title": "y"}}))
    assert sorted((r.key, r.title) for r in readers.json_registry(spark, str(tmp_path / "r.json"), "title string").collect()) == [("d1", "x"), ("d2", "y")]
    (tmp_path / "c.csv").write_text("승인일시,승인번호\n20240101,7\n")
    assert readers.csv_strings(spark, str(tmp_path / "c.csv"), ["승인번호"]).first()["승인번호"] == "7"
    with pytest.raises(ValueError, match="승인금액"):
        readers.csv_strings(spark, str(tmp_path / "c.csv"), ["승인금액"])
    os.makedirs(tmp_path / "q")
    (tmp_path / "q" / "a.sql").write_text("SELECT a FROM t1 JOIN s.t2 ON 1=1\n\n\n\nnotes only\n---\nselect b from t1")
    assert [r.tables for r in readers.sql_entries(readers.texts(spark, str(tmp_path / "q"), "*.sql")).collect()] == [["T1", "S.T2"], ["T1"]]
    files = readers.binaries(spark, str(tmp_path), "*.jsonl")
    pages = readers.extracted(files, lambda content: content.decode().splitlines()).collect()
    assert [p.page for p in pages] == [0, 1, 2]
    assert readers.extracted(files, lambda content: 1 / 0).first().error.startswith("ZeroDivisionError")


def test_changed_files_and_extractions(spark):
    source = spark.createDataFrame([("/a/x", 5), ("/b/x", 7), ("/a/y", 1)], "path string, modificationTime int")
    known = spark.createDataFrame([("x", 6), ("y", 1)], "name string, modificationTime int")
    assert [r.path for r in readers.changed_files(source, known).collect()] == ["/b/x"]
    a = spark.createDataFrame([("f", 0, "abc"), ("g", 0, "abc")], "path string, page int, text string")
    b = spark.createDataFrame([("f", 0, "abcd"), ("g", 0, "abc")], "path string, page int, text string")
    assert sorted((r.path, r.text) for r in readers.longer_extraction(a, b).collect()) == [("f", "abcd"), ("g", "abc")]


def test_named_queries(spark):
    named = readers.NamedQueries({"a": "SELECT 'today' AS x", "b": "SELECT 'today' AS x"}, {"a": "SELECT :d AS x"})
    assert [named.run(spark, k, d).first().x for k, d in (("a", None), ("a", "20240101"), ("b", "20240101"))] == ["today", "20240101", "today"]
    with pytest.raises(KeyError):
        named.run(spark, "c")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "index")
    for v in range(1, 8):
        sinks.write_version(spark.range(v), path, v)
    assert sinks.prune_versions(spark, path, 5) == [2, 1] and sinks.versions(spark, path) == [7, 6, 5, 4, 3]
    for f in os.listdir(f"{path}/version=7"):
        os.remove(f"{path}/version=7/{f}")
    assert sinks.latest(spark, path).count() == 6
    sinks.append_log(spark.createDataFrame([("q" * 50,)], "question string"), str(tmp_path / "log"), {"question": 10})
    sinks.append_log(spark.createDataFrame([("p",)], "question string"), str(tmp_path / "log"))
    assert sorted(len(r.question) for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 10]
    sinks.export_csv(spark.createDataFrame([("a,b", 1)], "x string, n int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().x == "a，b"


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"))

    def run(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    hourly = run(events.windowed(stream, late="60 days"), "complete", "hourly")
    assert sorted(map(tuple, hourly.collect())) == sorted(map(tuple, events.windowed(batch).collect()))
    means = {r.event_type: r for r in run(events.recent_means(stream), "update", "means").collect()}
    assert set(means) == {r.event_type for r in batch.select("event_type").distinct().collect()} and all(0 < r.n <= 50 for r in means.values())
    assert run(events.deduplicated(stream), "append", "once").count() == batch.select("event_id").distinct().count()
