import numpy as np
import pytest

from millrace.llm import embedding, queries
from tests.oracle import assert_matches

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links int"


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op4_embedding, queries.OP4_SQL, sf_dir)


def brute(rows, threshold):
    n = len(rows)
    fit = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    links = [[j for j in range(n) if j != i and fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
              and np.dot(a := np.array(rows[i][1], float), b := np.array(rows[j][1], float)) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold] for i in range(n)]
    root = [r[0] for r in rows]
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    return {rows[i][0]: (len(links[i]), root[i], root[i] == rows[i][0]) for i in range(n)}


@pytest.mark.parametrize("tile", [2048, 16])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding, "TILE", tile)
    monkeypatch.setattr(embedding, "STRIPE", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=16) * 0.14).astype(np.float32).tolist(), int(rng.integers(2))) for i in range(150)]
    rows += [(150 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, rows[0][1], None), (205, [], 1), (206, [2.0, 0.0], 1), (207, [1e-20, 0.0], 1), (208, [float("inf"), 1.0], 1)]
    want = brute(rows, 0.98)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(df).collect()}
    assert got == want
    assert max(n for n, _, _ in want.values()) > 3


def test_repeated_ids_are_one_node(spark):
    """Components by id, from all pairs of rows and rows of one id; n_links by row."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a, 0), (7, a, 0), (7, b, 0), (8, b, 0), (9, c, 0), (7, None, 0), (9, c, 0), (10, [-0.0, 0.0, 2.0], 0), (11, None, 1), (11, a, 1), (None, a, 0), (12, a, None)]
    got = embedding.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    want = [(5, 1, 5, True), (7, 1, 5, False), (7, 1, 5, False), (8, 1, 5, False), (9, 2, 9, True), (7, 0, 5, False), (9, 2, 9, True), (10, 2, 9, False), (11, 0, 11, True), (11, 0, 11, True), (None, 0, None, None), (12, 0, 12, True)]
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in got))) == sorted(map(str, want))


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) * np.where(rng.random((300, 64)) < 0.1, 30, 1)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, scale, error = embedding.quantise(unit)
    approx = codes.astype(float) @ codes.astype(float).T * np.outer(scale, scale)
    assert (np.abs(unit @ unit.T - approx) <= error[:, None] + error[None, :] + np.outer(error, error) + 1e-9).all()


def test_empty_table(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
