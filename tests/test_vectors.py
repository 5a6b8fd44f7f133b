import numpy as np
from pyspark.sql import functions as F

from millrace.operators import vectors
from millrace.operators.vectors import VectorIndex


def brute(x, q, k, keep=lambda i: True):
    out = []
    for name, v in q:
        near = sorted((sum((a - b) ** 2 for a, b in zip(w, v)), i) for i, w in x if w is not None and np.isfinite(w).all() and keep(i))[:k]
        out += [(name, place + 1, i) for place, (_, i) in enumerate(near)]
    return sorted(out)


def clustered(rng, n, middles=12, dim=8):
    centre = rng.normal(0, 20, (middles, dim))
    return [(i, (centre[i % middles] + rng.normal(0, 1, dim)).tolist()) for i in range(n)]


def test_exact_and_few_rows_read(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 40)
    rng = np.random.default_rng(3)
    x = clustered(rng, 1200)
    q = [(f"q{i}", (np.array(x[i * 7][1]) + 0.1).tolist()) for i in range(3)]
    built = VectorIndex.build(spark.createDataFrame([(i, v, i % 3) for i, v in x], "vec_id long, embedding array<double>, kind int"))
    index = VectorIndex(spark, built.path)
    asked = spark.createDataFrame(q, "query_id string, vector array<double>")
    assert sorted((r.query_id, r["rank"], r.id) for r in index.search(asked, 5).collect()) == brute(x, q, 5)
    assert 0 < index.rows_read.value < 600  # three of twelve clusters, of 1200 rows
    got = index.search(asked, 4, F.col("kind") == 1)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == brute(x, q, 4, lambda i: i % 3 == 1)


def test_only_folders_of_wanted_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 40)
    index = VectorIndex.build(spark.createDataFrame(clustered(np.random.default_rng(4), 600), "vec_id long, embedding array<double>"))
    one = int(index.cells[0])
    plan = index.vectors.where(F.col("cell").isin([one]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and len(index.vectors.where(F.col("cell").isin([one])).inputFiles()) >= 1


def test_ties_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 20)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = [(i, v.tolist()) for i, v in enumerate(rng.integers(-1, 2, (300, 3)).astype(float))] + [(900, None), (901, [float("nan"), 0.0, 0.0]), (902, [float("inf"), 0.0, 1.0])]
    q = [(i, v) for i, v in x[:20]]
    index = VectorIndex.build(spark.createDataFrame(x, "vec_id long, embedding array<double>"))
    asked = spark.createDataFrame([*q, (99, None)], "query_id long, vector array<double>")
    assert sorted((r.query_id, r["rank"], r.id) for r in index.search(asked, 7).collect()) == brute(x, q, 7)
    assert index.search(asked.limit(0), 3).collect() == []


def test_empty(spark):
    index = VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).collect() == []
