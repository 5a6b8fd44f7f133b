import random
from collections import Counter

import xxhash

from millrace.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp long, component_id string"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    n = 4 if len(words) >= 4 else len(words)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_dense_keys_in_blocks(spark, monkeypatch):
    """Near fingerprints around a few centres, so that keys outgrow a block."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng, prints = random.Random(3), {}
    for c in range(3):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                fp ^= 1 << b
            prints[fp] = fp
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    roots = {r.node: r.root for r in graph.components(simhash.near_links(spark.createDataFrame(signed, "fp long"))).collect()}
    got = Counter(roots.get(f[0], f[0]) for f in signed)
    assert sorted(got.values()) == sorted(Counter(brute_components(prints).values()).values())


def test_long_chains(spark, monkeypatch):
    """Keys of three segments, as for very many fingerprints, link the same pairs; copies of 0 to 6 bits around centres, of which the first is all zeros."""
    monkeypatch.setattr(simhash, "LONG_CHAINS", 0)
    assert max(len(simhash._flips(i, 3)) for i in range(5)) == 274
    rng, prints = random.Random(5), {}
    for c in range(4):
        centre = rng.getrandbits(64) if c else 0
        for _ in range(60):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                fp ^= 1 << b
            prints[fp] = fp
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    found = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {(x, y) for x in prints for y in prints if x != y and (x ^ y).bit_count() <= 4}
    assert found | {(b, a) for a, b in found} == want


def test_odd_rows(spark):
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, " \t\n", 5, None), (4, "A b", 1, "x"), (5, "a B", 1, "x"), (5, "a B", 1, "x"), (None, "a b", 1, "x"), (6, "w " * 50_000, 1, "x"), (7, "Ä ä", 1, "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, None, 6, 7)] == [1, 1, 1, 4, 4, 4, 6, 7]
    assert by_id[1].fp == 0
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 200)] + [(1, i) for i in range(300, 400)] + [(7, 7), (9, None), (350, 9)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 100 for i in range(101, 201))
    assert all(roots[i] == 1 for i in [9, *range(300, 400)])
    assert 7 not in roots and 1 not in roots
