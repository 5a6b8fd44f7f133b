import math
import random
from collections import Counter

import pytest

from millrace.operators import inverted
from millrace.operators.inverted import InvertedIndex, Weights


def brute(docs, queries, k, k1=1.5, b=0.75, epsilon=0.25):
    own = {i: [w for w in (t or "").lower().split() if len(w) > 1] for i, t in docs}
    n, avgdl = len(own), sum(map(len, own.values())) / len(own)
    df = Counter(t for words in own.values() for t in set(words))
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = []
    for q, text in queries:
        times, hits = Counter(w for w in (text or "").lower().split() if w in df), []
        for i, words in own.items():
            tf = Counter(words)
            score = round(sum(c * (epsilon * mean if idf[t] < 0 else idf[t]) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words) / avgdl)) for t, c in times.items()), 6)
            if score > 0:
                hits.append((-score, i))
        out += [(q, place + 1, i, -s) for place, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["the"] * 40 + ["of"] * 20 + [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(1500)] + [(5000, None), (5001, "")]
    docs += [(6000 + i, "zebra quagga the of") for i in range(12)] + [(7000, "zebra zebra the"), (7001, "quagga " * 30)]
    queries = [(1, "the of zebra quagga"), (2, "w1 w2 the the"), (3, ""), (4, None), (5, "unheard words"), (6, " ".join(rng.choices(words, k=30))), (7, "the")]
    return docs, queries


def frames(spark, corpus):
    return spark.createDataFrame(corpus[0], "doc_id long, text string"), spark.createDataFrame(corpus[1], "query_id long, text string")


@pytest.mark.parametrize("how", [Weights(), Weights(0.9, 0.3, -0.5)])
def test_equals_scoring_all_documents(spark, corpus, monkeypatch, how):
    monkeypatch.setattr(inverted, "BLOCK", 50)
    docs, queries = frames(spark, corpus)
    built = InvertedIndex.build(docs)
    index = InvertedIndex(spark, built.path)  # as another session would open it
    for k in (1, 5, 40, None):
        got = sorted((r.query_id, r["rank"], r.id, r.score) for r in index.search(queries, k, how).collect())
        want = brute(*corpus, k, how.k1, how.b, how.epsilon)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))


def test_most_lists_of_a_frequent_term_stay_packed(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 20)
    rng = random.Random(2)
    docs = [(i, "the of " + " ".join(f"x{rng.randrange(3000)}" for _ in range(8))) for i in range(2000)] + [(9000 + i, "zebra quagga the") for i in range(6)]
    index = InvertedIndex.build(spark.createDataFrame(docs, "doc_id long, text string"))
    read = {r.term: (r.lists, r.unpacked) for r in index.reads(spark.createDataFrame([(1, "the zebra quagga")], "query_id long, text string"), 5).collect()}
    assert read["the"][0] > 90 and read["the"][1] <= 6 and read["zebra"][0] == read["zebra"][1]


def test_folders_are_pruned(spark, corpus):
    docs, queries = frames(spark, corpus)
    index = InvertedIndex.build(docs)
    assert sorted(f.name for f in index.postings.schema) == ["block", "bucket", "list", "term", "tops"]
    assert index.postings.where("bucket = 3").inputFiles() and all("bucket=" in f for f in index.postings.inputFiles())


def test_empty(spark):
    index = InvertedIndex.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(spark.createDataFrame([(1, "a word")], "query_id long, text string"), 3).collect() == []
