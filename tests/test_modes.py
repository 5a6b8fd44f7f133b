import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import embed, modes


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["red apple pie recipe", "green apple cider", "blue whale song", "whale watching tour", "red brick wall", "", None]
    rows = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return embed.embed(rows, "text", embed.hashed_words())


def overlap(question, text):
    return pd.Series([len(set(q.split()) & set(t.split())) for q, t in zip(question, text)], dtype=float)


@pytest.mark.parametrize("name", sorted(modes.MODES))
def test_modes_find_what_is_asked(spark, docs, name):
    questions = spark.createDataFrame([(1, "red apple"), (2, "whale song"), (3, "  "), (4, None)], "query_id long, text string")
    rows = modes.search(docs.where("text IS NOT NULL"), questions, modes.MODES[name], embed.hashed_words(), overlap, [lambda x: F.upper(x), lambda x: F.reverse(x)]).collect()
    best = {r.query_id: r.id for r in rows if r["rank"] == 1}
    assert best == {1: 0, 2: 2}
    assert max(r["rank"] for r in rows) <= modes.MODES[name].best


def test_variants_are_distinct(spark):
    q = spark.createDataFrame([(1, "what is the fee"), (2, "fee")], "query_id long, text string")
    got = modes.variants(q, [lambda x: modes.without_noise(x, ["what is", r"\bthe\b"]), F.upper, F.reverse]).collect()
    assert [(r.query_id, r.variant, r.text) for r in got] == [(1, 0, "what is the fee"), (1, 1, "fee"), (1, 2, "WHAT IS THE FEE"), (2, 0, "fee"), (2, 1, "FEE"), (2, 2, "eef")]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "query_id long, rank int, id long")
    relevant = spark.createDataFrame([(1, 6), (2, 7), (3, 9)], "query_id long, id long")
    r = modes.evaluate(hits, relevant, 2).first()
    assert (r.questions, round(r.hit_rate, 4), round(r.top1, 4), round(r.precision, 4)) == (3, 0.6667, 0.3333, 0.5)
