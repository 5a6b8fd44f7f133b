import math

import numpy as np
import pandas as pd
import pytest

from millrace.llm import mtree, queries
from tests.oracle import assert_matches

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, shard int"


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op3_mtree, queries.OP3_SQL, sf_dir)


def brute(rows, every, k=10):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])}
    return out


def brute_rows(rows, every, k=10):
    whole = [(i, np.floor(1024 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows]
    out = []
    for i, q in whole:
        if i % every == 0:
            scores = sorted((-int(q @ v), j) for j, v in whole if j != i and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("shard, page", [(8192, 128), (40, 4)])
def test_against_brute_force(spark, monkeypatch, shard, page):
    monkeypatch.setattr(mtree, "SHARD", shard)
    monkeypatch.setattr(mtree, "QUERIES", 5)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, None), (310, []), (320, [None] * 8), (330, [float("nan")] * 8), (340, [1.0, 2.0]), (351, [3.0, 2.0]), (360, [3e18] * 8), (None, rows[0][1])]
    rows = [r for r in rows if r[0] != 360]
    got = mtree.top_k(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), every=10).collect()
    assert {tuple(r) for r in got} == brute(rows, 10)
    assert len(got) == len(brute(rows, 10))


def test_bounds_spare_computations():
    """On clustered vectors most entries are ruled out unseen, and the answer stays exact."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(40, 16))[rng.integers(40, size=4000)] * 4000 + rng.normal(size=(4000, 16)) * 100).astype(np.int64)
    pages = pd.DataFrame(mtree.build(np.arange(4000), vectors))
    pages["page"] = np.arange(len(pages))
    tree = mtree.Tree(pages, 16)
    for i in range(0, 4000, 400):
        scores = vectors @ vectors[i]
        want = sorted(((int(s), j) for j, s in enumerate(scores) if j != i), key=lambda x: (-x[0], x[1]))[:10]
        assert tree.search(i, vectors[i], 10) == want
    assert tree.computed < 10 * 4000 * 0.5


def test_queries_are_sent_to_few_shards(spark, monkeypatch):
    """On clustered vectors the pivots' bounds keep most queries from most shards, and the answer stays exact."""
    monkeypatch.setattr(mtree, "SHARD", 50)
    sent, meet = [], mtree._meet
    monkeypatch.setattr(mtree, "_meet", lambda pages, routed, k: (sent.append((routed.count(), pages.select("dim", "cell", "part").distinct().count())), meet(pages, routed, k))[1])
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.02).astype(np.float32).tolist()) for i in range(2000)]
    got = mtree.top_k(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), every=20).collect()
    assert {tuple(r) for r in got} == brute(rows, 20)
    shards = sent[1][1]
    assert shards > 20 and sent[0][0] == 100 and sent[1][0] < 100 * shards * 0.25


def test_repeats_and_long_vectors(spark, monkeypatch):
    """A hot row, a query id with two vectors, and vectors so long that a shard holds few of them."""
    monkeypatch.setattr(mtree, "SHARD", 16)
    monkeypatch.setattr(mtree, "SHARD_VALUES", 40_000)
    rng = np.random.default_rng(9)
    long = [(1000 + i, rng.normal(size=10_000).astype(np.float32).tolist()) for i in range(12)]
    short = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 60)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 90
    rows = long + short
    got = mtree.top_k(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), every=10).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_rows(rows, 10))
    two = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 7.0]), (3, [1.0, 1.0])]
    best = mtree.top_k(spark.createDataFrame([(*r, 1, "x", 2) for r in two], SCHEMA), k=2, every=10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in best] == [(2, 7 << 20), (1, 5 << 20)]


def test_large_components_are_exact():
    big = np.array([[1 << 40, 3], [1 << 40, 1]], np.int64)
    assert mtree.dots(big, np.array([1 << 20, 1], np.int64)).tolist() == [(1 << 60) + 3, (1 << 60) + 1]


def test_empty_table(spark):
    assert mtree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
