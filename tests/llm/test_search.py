import math
import random
import re
from collections import Counter

import numpy as np

from millrace.llm import queries, search
from tests.oracle import assert_matches

DOCS = "doc_id long, text string, score long, item int"
ITEMS = "item_id long, text string, doc_id int"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k=20):
    own = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        hits = []
        for doc, c in own:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s > 0:
                hits.append((-s, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=20, parts=3):
    index = search.Index(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS).repartition(parts))
    return sorted(map(tuple, index.top_k(spark.createDataFrame([(*i, 5) for i in items], ITEMS), k).collect()), key=str)


def made(rng, n, vocab):
    return [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for i in range(n)]


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op13_search, search.SQL, sf_dir)


def test_against_brute_force_in_small_shards(spark, monkeypatch):
    rng = random.Random(5)
    vocab = ["the"] * 20 + [f"W{i}" for i in range(40)] + ["été", "日本", "x-y", "q_r", "A1", "..."]
    docs, items = made(rng, 700, vocab), [(1000 + i, t) for i, t in made(rng, 30, vocab)]
    rng.shuffle(docs)
    shards = search._shards
    monkeypatch.setattr(search, "FLOOR_SHARE", 3)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 11)

    def small(batches):  # the limits are set where the tasks run
        search.SHARD_DOCS, search.SHARD_POSTINGS = 29, 300
        yield from shards(batches)

    monkeypatch.setattr(search, "_shards", small)
    for k in (1, 5, 20, 1000):
        assert found(spark, docs, items, k) == brute(docs, items, k)


def test_ties_repeats_and_odd_rows(spark):
    docs = [(9, "a b"), (3, "a b"), (3, "A b"), (None, "a b"), (5, "b a"), (7, None), (8, ""), (10, " .,; "), (11, "c " * 200_000), (12, "d"), (-4, "b a")]
    items = [(1, "a"), (1, "b b"), (2, None), (3, "..."), (None, "C d"), (4, "unknown words"), (5, "a, A; b")]
    assert found(spark, docs, items, 20) == brute(docs, items, 20)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_tree_opens_few_nodes():
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"t{j}" for j in rng.integers(0, 2000, 40)) + (" rare word pair" if i in (77, 3000) else "")) for i in range(4096)]
    import pyarrow as pa

    shard = next(search._shards([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]})])).to_pylist()[0]
    asked = {t: i for i, t in enumerate([b"rare", b"word", b"pair", b"t1", b"t2", b"t3"])}
    tree = search.Tree(shard, asked, 4096, shard["n_terms"])
    touched, impact = [0], tree.impact

    class Counting(np.ndarray):
        def __getitem__(self, key):
            touched[0] += len(key[1]) if isinstance(key, tuple) and getattr(key[1], "ndim", 0) == 2 else 0
            return np.asarray(self).__getitem__(key)

    tree.impact = impact.view(Counting)
    got = tree.search([(i, 1000) for i in range(6)], 2, 1)
    assert sorted(p for _, p in got) == [77, 3000]
    assert touched[0] < 1000  # children of opened nodes; the tree has 8191
