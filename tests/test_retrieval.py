import numpy as np

from millrace.operators import retrieval, topn


def test_ties_go_to_the_smaller_id_whatever_the_order(spark):
    """More equal vectors in a batch than four times k, the smallest ids last."""
    vectors = [(i, [0.1, 0.2, 0.3]) for i in range(200, 0, -1)] + [(i, [0.1 * i, 0.0, 1.0]) for i in range(300, 320)]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [30.0, 0.0, 1.0])], "query_id long, vector array<double>")
    got = retrieval.vector_search(docs, queries, 5).collect()
    assert sorted((r["rank"], r.id) for r in got if r.query_id == 1) == [(i, i) for i in range(1, 6)]
    assert sorted((r["rank"], r.id) for r in got if r.query_id == 2) == [(i + 1, x) for i, x in enumerate((300, 301, 302, 303, 304))]


def test_blocks_of_queries_and_shards_of_vectors(spark, monkeypatch):
    """More queries than are sent to every task, against all pairs, with many ties."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 3)).astype(float)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x[:70])], "query_id string, vector array<double>")
    want = {f"q{i}": sorted((((x[i] - v) ** 2).sum(), j) for j, v in enumerate(x))[:7] for i in range(70)}
    for sent, shard, pairs in ((2048, 8192, 100_000), (20, 64, 100_000), (20, 64, 50)):
        monkeypatch.setattr(retrieval, "SENT_QUERIES", sent)
        monkeypatch.setattr(retrieval, "SHARD", shard)
        got = {}
        for r in retrieval.vector_search(docs, queries, 7).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.id)
        assert {q: [v for _, v in sorted(found.items())] for q, found in got.items()} == want
    monkeypatch.setattr(retrieval, "EXACT_PAIRS", 10)
    row, ids, distance = retrieval.nearest(x[:20], x, np.arange(300), 7)
    assert [(d, i) for d, i in zip(distance, ids)] == [p for i in range(20) for p in want[f"q{i}"]]
    assert retrieval.vector_search(docs, queries.limit(0), 7).count() == 0


def test_nearest_rank_in_slices(spark):
    rng = np.random.default_rng(4)
    values = [("a", int(v)) for v in rng.exponential(1000, 500)] + [("b", 7)] * 3 + [(None, v) for v in (5, 1, 9)] + [("c", None)]
    df = spark.createDataFrame(values, "g string, v long")
    got = {r.g: (r.n, r.low, r.high) for r in topn.nearest_rank(df, "g", "v", {"low": 0.5, "high": 0.95}, slices=20).collect()}
    for g in ("a", "b", None):
        own = sorted(v for k, v in values if k == g)
        assert got[g] == (len(own), own[int(len(own) * 0.5)], own[min(int(len(own) * 0.95), len(own) - 1)])
