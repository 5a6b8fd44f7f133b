"""Sources and sinks: databases, manifests, table functions, intake, half-structured texts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.errors import IndexMissing
from millrace.operators import embed
from millrace.sources import readers, sinks
from millrace.streaming import ingest

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 1.5).alias("price"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="GOODS", **DERBY).save()
    return url


def test_database_read_in_ranges_with_filters_sent_along(spark, database):
    rows = readers.jdbc(spark, database, "GOODS", column="k", parts=4, **DERBY)
    assert rows.rdd.getNumPartitions() == 4
    few = rows.where("price > 120").select("name")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(price,120.0)" in plan and "ReadSchema: struct<name:string>" in plan
    assert few.count() == 19 and rows.count() == 100  # null keys are in the first range
    assert readers.jdbc(spark, database, 'SELECT "name" AS n FROM GOODS WHERE "k" < 5', **DERBY).count() == 4
    by_query = readers.jdbc(spark, database, 'SELECT "k" AS k, "name" AS n FROM GOODS WHERE "k" > 50', column="K", parts=3, **DERBY)
    assert by_query.rdd.getNumPartitions() == 3 and by_query.count() == 45


def test_database_catalog(spark, database):
    got = [(r.position, r.column, r.type, r.nullable) for r in readers.jdbc_columns(spark, database, tables="GOODS", **DERBY).collect()]
    assert got == [(1, "k", "BIGINT", True), (2, "name", "CLOB", False), (3, "price", "DOUBLE", False)]
    assert readers.jdbc_columns(spark, database, tables="NONE", **DERBY).count() == 0


def test_manifest_finds_every_kind_of_damage(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).select("id", F.concat(F.lit("r"), "id").alias("name"), F.create_map(F.lit("k"), "id").alias("m")).repartition(3)
    for v in (1, 2, 3, 4, 5):
        sinks.write_version(rows.where(F.col("id") < 10 * v), path, v)
    assert sinks.current(spark, path) == 5 and sinks.fault(spark, path, 5) is None
    files = lambda v: sorted(f for f in os.listdir(f"{path}/version={v}") if f.startswith("part"))
    sinks.shorten_last_file(spark, f"{path}/version=5")
    assert sinks.fault(spark, path, 5).startswith("files of other lengths")
    os.remove(f"{path}/version=4/{files(4)[0]}")
    assert sinks.fault(spark, path, 4).startswith("files missing")
    whole = bytearray(open(f"{path}/version=3/{files(3)[-1]}", "rb").read())
    whole[4:60] = bytes(56)  # the length stays
    open(f"{path}/version=3/{files(3)[-1]}", "wb").write(whole)
    crc = f"{path}/version=3/.{files(3)[-1]}.crc"
    os.path.exists(crc) and os.remove(crc)
    assert sinks.fault(spark, path, 3, deep=False) is None and sinks.fault(spark, path, 3) is not None
    assert sinks.latest(spark, path).count() == 20
    with pytest.raises(IndexMissing):
        sinks.restore(spark, path, 4)
    sinks.restore(spark, path, 1)
    assert sinks.current(spark, path) == 1 and sinks.latest(spark, path).count() == 10
    sinks.append_version(rows.where("id = 39"), path, 1)
    assert sinks.latest(spark, path).count() == 11
    os.remove(f"{path}/version=1/{sinks.MANIFEST}")
    with pytest.raises(IndexMissing, match="no manifest"):
        sinks.latest(spark, path)


def test_checksum_is_of_rows_not_of_their_order(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "i int, s string")
    assert sinks.checksum(a) == sinks.checksum(a.orderBy(F.desc("i")).repartition(3)) != sinks.checksum(a.dropDuplicates())
    assert sinks.checksum(a.limit(0)) == (0, "0")


def test_pages_before_a_fault_stay(spark):
    def extract(content):
        for line in content.decode().split("|"):
            yield str(10 // int(line)) if line.strip() else " "

    files = spark.createDataFrame([("a", bytearray(b"1|2| |5")), ("b", bytearray(b"5|0|1")), ("c", bytearray(b"x"))], "path string, content binary")
    got = sorted((r.path, r.page, r.text, (r.error or "")[:9]) for r in readers.extracted(files, extract).collect() if r.text) + sorted((r.path, r.page, "", r.error[:9]) for r in readers.extracted(files, extract).where("error is not null").collect())
    assert got == [("a", 0, "10", ""), ("a", 1, "5", ""), ("a", 3, "2", ""), ("b", 0, "2", ""), ("b", 1, "", "ZeroDivis"), ("c", 0, "", "ValueErro")]


def test_repeated_batch_adds_nothing(spark, tmp_path):
    source, target, known = (str(tmp_path / n) for n in ("in", "out", "known"))
    spark.range(10).write.json(f"{source}/a")
    again = lambda: ingest.ingest(spark, source, "id long", target, known, lambda df: df.where("id <> 3"))
    assert again() == 1 and again() == 0
    spark.range(10, 15).write.json(f"{source}/b")
    assert again() == 1
    for name in ("1", ".1.crc"):
        os.remove(f"{known}/commits/{name}")
    assert again() == 1
    got = sorted((r.id, r.batch) for r in ingest.taken(spark, target).collect())
    assert got == [(i, 0) for i in range(10) if i != 3] + [(i, 1) for i in range(10, 15)]


def test_geojson_of_unlike_properties(spark):
    texts = [
        ("a", '{"features": [{"properties": {"NM": " x ", "n": 1}}, {"properties": {"name": "other", "deep": {"k": [1]}}}]}'), ("b", '{"features": []}'), ("c", "no json"), ("d", None),
        ("e", '{"features": [{"properties": {"title": "t"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}'),
    ]
    found = readers.geojson_features(spark.createDataFrame(texts, "path string, text string"))
    assert sorted((r.path, r.at, r.name) for r in found.collect()) == [("a", 0, "x"), ("a", 1, None), ("e", 0, None)]
    assert readers.variant_fields(found, "properties") == "OBJECT<NM: STRING, deep: OBJECT<k: ARRAY<BIGINT>>, n: BIGINT, name: STRING, title: STRING>"


def test_descriptions_and_specs(spark):
    tables = [("j", '{"a": "first", "b": "second"}'), ("two", "컬럼명\t설명\na\tfirst\nalone\n\tno name"), ("four", "a\tN\tfirst\tmore\r\nb\tC\tsecond"), ("none", ""), ("null", None)]
    got = sorted((r.table, r.column, r.type, r.description) for r in readers.column_descriptions(spark.createDataFrame(tables, "table string, text string")).collect())
    assert got == [("four", "a", "N", "first"), ("four", "b", "C", "second"), ("j", "a", None, "first"), ("j", "b", None, "second"), ("two", "a", None, "first")]
    lines = ["환자 번호 ptno C 10 NN 등록 번호", "금액(원) amt N 12.2", "no spec here", "", "x y C 1 z N 3 last", "Name ID C 3", "a b. c1 N 2"]
    got = [tuple(r) for r in readers.column_specs(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("환자 번호", "ptno", "C", "10", "NN", "등록 번호"), ("금액(원)", "amt", "N", "12.2", "", ""), ("x y C 1", "z", "N", "3", "", "last")]


def test_known_texts_are_not_encoded_again(spark, tmp_path):
    seen, inner = spark.sparkContext.accumulator(0), embed.hashed_words(8)

    def encoder():
        encode = inner()

        def run(texts):
            seen.add(len(texts))
            return encode(texts)

        return run

    df, store = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None)], "i int, t string"), str(tmp_path / "v")
    first = {r.i: r.embedding for r in embed.remembered(df, "t", encoder, store).collect()}
    assert seen.value == 3 and first[1] == first[3] and len(first) == 4
    more = df.unionByName(spark.createDataFrame([(5, "new")], "i int, t string"))
    again = {r.i: r.embedding for r in embed.remembered(more, "t", encoder, store).collect()}
    assert seen.value == 4 and {i: again[i] for i in first} == first
