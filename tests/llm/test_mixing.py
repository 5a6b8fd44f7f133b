import hashlib
import math
import re
from collections import defaultdict

import pytest

from millrace.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def brute_targets(sizes, total, weights=(5, 2, 1)):
    """Round by round: what a source has too much is shared anew among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}
    while len(out) < len(order):
        left, open_ = total - sum(out.values()), [s for s in order if s not in out]
        share = left / sum(weight[s] for s in open_)
        full = {s: 2.0 * sizes[s] for s in open_ if weight[s] * share >= 2 * sizes[s]}
        out |= full or {s: weight[s] * share for s in open_}
    return out


def brute(docs, seed="mix"):
    """The mix by sorting each source as a whole. docs: (doc_id, text, source)."""
    by_source = defaultdict(list)
    for doc_id, text, source in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        digest = hashlib.md5(f"{seed}\x1f{doc_id}\x1f{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 2**52
        letters = len([c for c in text or "" if c not in "0123456789!#$%&()*+/<=>@[\\]^_{|}~"])
        by_source[source].append((-math.log(u) / max(0.05, letters / len(text) if text else 0.05), doc_id, size))
    sizes = {s: sum(x[2] for x in rows) for s, rows in by_source.items()}
    target = brute_targets(sizes, 1.5 * sum(sizes.values()))
    out = {}
    for s, rows in by_source.items():
        epochs = min(2, int(target[s] // sizes[s])) if sizes[s] else 0
        rest, so_far = (target[s] - epochs * sizes[s] if epochs < 2 else 0), 0
        for key, doc_id, size in sorted(rows):
            nearer = so_far + size <= rest or (rest > so_far and so_far + size - rest < rest - so_far)
            out[doc_id] = size * (epochs + (rest > 0 and nearer))
            so_far += size
    return out, target, sizes


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_against_brute_force(spark, sf_dir, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, target, sizes = brute(docs.select("doc_id", "text", "source").collect())
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r.taken for r in rows} == want
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1


@pytest.mark.parametrize("range_rows", [20_000, 2])
def test_targets_are_capped_and_reshared(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    for sizes in ({"a": 10, "b": 1000, None: 100, "c": 100}, {"a": 0}, {"a": 0, "b": 5}, {chr(97 + i): (i * 37) % 50 for i in range(20)} | {None: 7}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df, 1.5).collect()}
        assert got == pytest.approx(brute_targets(sizes, 1.5 * sum(sizes.values())))
    assert mixing.targets(df.limit(0), 1.5).count() == 0


def test_ranges_stay_even_for_uneven_weights_and_equal_rows(spark, monkeypatch):
    """A half of the rows weighs 0.05 and a half 1; and a third of the rows is one document."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 200)
    tables = []
    monkeypatch.setattr(mixing, "cut", lambda df, name, cut=mixing.cut: tables.append((name, cut(df, name))) or tables[-1][1])
    rows = [(i, ("#" * 40 if i % 2 else "prose of words") + f" {'w' * (i % 7)}", "a", "", 0) for i in range(4000)] + [(9, "prose of words", "a", "", 0)] * 2000
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), budget=0.5).collect()
    ranged = dict(tables)["ranged"]
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert len(sizes) == 30 and max(sizes) <= 3 * 200
    assert len(got) == 6000 and abs(sum(r.taken for r in got) - got[0].target) <= 2


def test_odd_rows(spark):
    rows = [(1, None, "x", "s", 1), (2, "", None, "s", 1), (3, "a b c", None, None, 1), (3, "a b c", None, "s", 1), (4, "w " * 40_000, "y", "s", 1), (None, "u v", "x", "s", 1)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == [0, 0, 2, 3, 3, 40_000]
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
