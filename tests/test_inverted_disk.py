import random

from millrace.operators import inverted
from millrace.operators.inverted import InvertedIndex
from tests.test_inverted import brute


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_are_not_shuffled_row_by_row(spark):
    rng = random.Random(4)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(4000)]
    queries = [(q, " ".join(rng.choices(vocabulary, k=5))) for q in range(20)]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    before = shuffled(spark)
    assert InvertedIndex.build(table).search(asked, 3).count() == 60
    assert shuffled(spark) - before < sum(len(t) for _, t in docs) / 4


def test_frequent_words_long_documents_and_text_ids(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(f"d{i}", " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=rng.randint(1, 30)))) for i in range(60)]
    docs += [("long", "aa " * 300 + "bb " * 70_000 + "ee"), ("longer", "ee ff " * 256), ("none", None)]
    queries = [(q, t) for q, t in enumerate(["aa ee", "bb ff", "ee", "ff ff cc", "gg", "dd aa"])]
    monkeypatch.setattr(inverted, "BLOCK", 7)
    monkeypatch.setattr(inverted, "QUERIES", 2)
    index = InvertedIndex.build(spark.createDataFrame(docs, "doc_id string, text string"))
    asked = spark.createDataFrame(queries, "query_id int, text string")
    for k in (2, None):
        got, want = sorted((r.query_id, r["rank"], r.id, r.score) for r in index.search(asked, k).collect()), brute(docs, queries, k)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))
