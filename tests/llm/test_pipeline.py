import json
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, quality
from tests.llm.test_copies import brute_groups
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_packing import check, expected_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from millrace.llm.common import cut

    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], sf_dir), name))
    return out


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert public_tokenizers.path("byte_bpe_50k.json") and corpus_pipeline.ORACLE_SQL is None


def test_classifiers_take_effect(stages, sf_dir, spark):
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages[:3]]
    assert ids[0] >= ids[1] >= ids[2]
    model = langid.fit(stages[0].where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"))
    rows = stages[0].select("doc_id", "text").collect()
    langs, _, ambiguous = model.predict([r.text for r in rows])
    assert ids[1] == {r.doc_id for r, lang, a in zip(rows, langs, ambiguous) if lang != "und" and not a}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    judge = quality.fit(stages[1], labels)
    rows = stages[1].select("doc_id", "text").collect()
    scores = [judge.scores(quality.np.array([quality.statistics(r.text)]))[0] for r in rows]
    assert ids[2] == {r.doc_id for r, s in zip(rows, scores) if s >= 0.7}
    assert len(ids[1]) > 0.97 * len(ids[0])


def test_one_of_each_group_stays(stages):
    """Groups of documents linked by a similarity of 0.8 or more of their five-word shingles, from all pairs."""
    groups = brute_groups({r.doc_id: r.text for r in stages[2].collect()})
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(groups.values()))


def test_mix_and_packing(stages):
    rows = stages[3].collect()
    want, _, _ = brute_mix([(r.doc_id, r.text, r.source) for r in rows])
    size = {r.doc_id: len(r.text.split()) for r in rows}
    got = Counter(r.doc_id for r in stages[4].collect())
    assert got == Counter({i: t // size[i] for i, t in want.items() if t})
    pieces = stages[5].collect()
    ids = dict(zip(size, expected_ids([r.text for r in rows])))
    numbered, seen = [], Counter()
    for p in pieces:
        key = json.dumps([p.doc_id, seen[p.doc_id, p.start]])
        seen[p.doc_id, p.start] += 1
        numbered.append(type(p)(**{**p.asDict(), "doc_id": key}))
    assert check(numbered, {json.dumps([i, k]): ids[i] for i, n in got.items() for k in range(n)}) > 0.9


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "a", 0), (None, "the end of it", None, None, 3), (None, "the end of it", "en", "a", 3), (None, "all that was the other thing", "en", "a", 3), (2, "the end of it", "en", "a", 3), (2, "the end of it", "en", "a", 3), (3, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.distinct(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "all that was the other thing"), (1, ""), (2, "the end of it")]
    mixed = corpus_pipeline.mixed(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= {None, 2} and mixed
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).count() <= 2 * len(rows)


def test_mixing_tells_rows_of_one_id_apart(spark, sf_dir):
    """Rows that repeat an id with other texts are taken each as often as the mix takes that row; clashing columns stay."""
    rows = [(1, f"{'w ' * (i + 1)}end{i}", "en", "ab"[i % 2], 0, "k", i) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA + ", key string, times int")
    got = Counter(corpus_pipeline.mixed(spark, docs, sf_dir).collect())
    taken = {r.text: r.n for r in mixing.mix(corpus_pipeline.keyed(docs), carry=("key",)).selectExpr("key.h1 as h1", "taken div size as n").join(corpus_pipeline.keyed(docs).selectExpr("key.h1 as h1", "text"), "h1").collect()}
    assert {r.text: n for r, n in got.items()} == {t: n for t, n in taken.items() if n}
    assert set(taken.values()) == {1, 2} and {r.key for r in got} == {"k"}


def test_columns_of_any_name_and_type(spark, sf_dir):
    """Maps, names with backticks and dots, a very long text; rows that differ in such a column only are told apart."""
    docs = spark.createDataFrame([(i, t, "en", "a", 0, {"k": str(i % 2)}, i) for i, t in enumerate(["the end of it and all that"] * 2 + ["of the other thing " * 50_000, None])], SCHEMA + ", m map<string,string>, n int")
    docs = docs.withColumnRenamed("n", "a`b.c")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and all(r["a`b.c"] == r.doc_id and r.m == {"k": str(r.doc_id % 2)} for r in out.collect()), name
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf_dir).collect()) == [0, 2, 3]
    twins = spark.createDataFrame([(1, "w " * 10, "en", "a", 0, {"k": str(i)}) for i in range(6)], SCHEMA + ", m map<string,string>")
    taken = lambda df: Counter(r.m["k"] for r in corpus_pipeline.mixed(spark, df, sf_dir).collect())
    assert taken(twins.repartition(4)) == taken(twins.coalesce(1).orderBy(F.desc(F.col("m")["k"])))
