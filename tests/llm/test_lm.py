import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import lm, queries

SCHEMA = "doc_id long, text string, word string, n int, train boolean"


def brute_tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


class Brute:
    """The same model from plain dictionaries, token by token."""

    def __init__(self, texts):
        read = [["<s>", *brute_tokens(t)] for t in texts]
        self.grams = [Counter(g for ws in read for g in zip(*(ws[i:] for i in range(k)))) for k in (1, 2, 3)]
        starts = self.grams[0].pop(("<s>",), 0)
        self.N, self.V, self.c = sum(self.grams[0].values()), len(self.grams[0]), {g[0]: n for g, n in self.grams[0].items()}
        self.seen = {**self.grams[0], ("<s>",): starts, **self.grams[1]}
        self.arcs = {g: n - 0.75 for level in self.grams[1:] for g, n in level.items() if n >= 2}
        self.given = Counter()
        for g, n in self.arcs.items():
            self.given[g[:-1]] += n

    def p(self, history, w):
        if not history:
            return (self.c.get(w, 0) + 0.1) / (self.N + 0.1 * (self.V + 1))
        if not self.seen.get(history):
            return self.p(history[1:], w)
        return (self.arcs.get((*history, w), 0) + (self.seen[history] - self.given[history]) * self.p(history[1:], w)) / self.seen[history]

    def score(self, text):
        ws = ["<s>", *brute_tokens(text)]
        return sum(math.log10(self.p(tuple(ws[max(0, i - 2) : i]), ws[i])) for i in range(1, len(ws)))

    def check(self, text, r):
        ws = brute_tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in self.c for w in ws), self.N)
        assert r.base_score == pytest.approx(sum(math.log10(self.p((), w)) for w in ws))
        assert r.score == pytest.approx(self.score(text), rel=1e-9)


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    vocabulary = [f"W{i}" for i in range(40)]
    make = lambda: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 30)))
    train = [make() for _ in range(120)] + ["a b c d e f g"] * 6 + ["rare pair here", "x rare pair here y", "", None]
    tests = train[:10] + [make() + " unseen words w1" for _ in range(10)] + ["A b\tc d\ne f g", "pair here unseen", "w1 rare W2", "", None]
    texts = [*train, *tests]
    brute = Brute(train)
    df = spark.createDataFrame([(i, t, "x", 1, i < len(train)) for i, t in enumerate(texts)], SCHEMA).repartition(partitions)
    rows = lm.score(df, F.col("train")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        brute.check(texts[r.doc_id], r)
    for history in [(), ("<s>",), ("w0",), ("w1",), ("w0", "w1"), ("<s>", "w0"), ("a", "b")]:
        assert sum(brute.p(history, w) for w in [*brute.c, "unseen"]) == pytest.approx(1)


def test_query(spark, sf_dir):
    """Every score of the query, and that it gains on the base model for held-out texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    brute = Brute([d.text for d in docs if zlib.crc32(str(d.doc_id).encode()) % 10])
    got = {r.doc_id: r for r in queries.op6_lm(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        brute.check(d.text, got[d.doc_id])
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None, "x", 1, True), (2, "", "x", 1, True), (3, "w " * 30_000 + "y" * 90_000, "x", 1, True), (4, "a b", "x", 1, True), (4, "a b", "x", 1, True), (None, "a b", "x", 1, True), (5, "zz", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lm.score(df, F.col("train")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 3, 3), (1, 1, 1), (2, 1, 1), (3, 30_002, 30_002), (4, 3, 3), (4, 3, 3), (5, 2, 1)]
    brute = Brute([r[1] for r in rows if r[4]])
    for r in got:
        brute.check({x[0]: x[1] for x in rows}[r.doc_id], r)
    assert lm.score(df.limit(0), F.col("train")).count() == 0
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.n_known == 0 for r in lm.score(df, F.lit(False)).collect())
    clash = df.select("doc_id", "text", "train", F.lit(1).alias("batch"), F.lit(2).alias("part"), F.lit(3).alias("n_tokens"))
    assert sorted(r.score for r in lm.score(clash, F.col("train")).collect()) == pytest.approx(sorted(r.score for r in got))


def test_scratch_is_deleted(spark):
    there = lambda: set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    before = there()
    lm.score(spark.createDataFrame([(1, "a b", "x", 1, True)], SCHEMA), F.col("train")).collect()
    assert [name.split("-")[0] for name in there() - before] == ["scores"]


def test_packing_of_arrays():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()
    assert (lm.unpacked(lm.packed(keys), np.uint64) == keys).all()
    assert len(lm.unpacked(lm.packed(keys[:0]), np.float64)) == 0
