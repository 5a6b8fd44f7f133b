import random
from collections import defaultdict

import corpus_pipeline

from millrace.llm import copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_groups(texts):
    sets, parent = {i: brute_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    """Copies at 0.8 and just below it, most with fingerprints of more than four differing bits, and a group joined by a chain."""
    rng, texts = random.Random(5), {}
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for n in (0, 2, 3, 4, 5, 6):
            texts[len(texts)] = edited(rng, words, n)
    want = brute_groups(texts)
    assert 40 < len(set(want.values())) < len(want) - 80
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], SCHEMA)
    groups = defaultdict(set)
    for r in copies.near_copies(docs).collect():
        groups[r.root].add(r.key)
    assert {min(g): len(g) for g in groups.values()} == {i: list(want.values()).count(i) for i in set(want.values())}
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf_dir).collect()) == sorted(set(want.values()))


def test_large_buckets_in_blocks(spark, monkeypatch):
    """One group of copies around 0.8, larger than a block, and a bucket's pairs compared without being made."""
    monkeypatch.setattr(copies, "SMALL", 4)
    monkeypatch.setattr(copies, "SIDE", 8)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    texts = {i: edited(rng, words, rng.choice((2, 3, 4, 9))) for i in range(60)}
    want = brute_groups(texts)
    assert 3 < len(set(want.values())) < 50
    groups = defaultdict(set)
    for r in copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        groups[r.root].add(r.key)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in want if want[i] == g) for g in set(want.values()))


def test_repeated_ids_lose_no_group(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1)]
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.distinct(spark, spark.createDataFrame(order, SCHEMA), sf_dir).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b), (3, c)]
