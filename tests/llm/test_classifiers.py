import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid, quality, queries

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"
ODD = [(1, None, "en", "x", 1), (2, "", "fr", "x", 1), (3, "123 !!", None, "x", 1), (4, "the end of the thing", "en", "x", 1), (4, "the end of the thing", "en", "x", 1), (None, "où est la voiture élevée", "fr", "x", 1), (5, "the thing " * 20_000, "en", "x", 1), (6, "la voiture est élevée", "fr", "x", 1)]


def test_language_held_out(spark):
    rows = queries.op1_langid(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = rows.join(docs, "doc_id").where("held_out").collect()
    assert len(both) > 150 and np.mean([r.lang_pred == r.lang for r in both]) > 0.97
    assert all(0 <= r.score <= 1 for r in both)
    assert np.mean([r.ambiguous for r in both]) < 0.02


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 5, 6)] == ["und", "und", "und", "en", "fr", "en", "fr"]
    assert langid.identify(df, model).count() == len(ODD) and langid.keep(df, model).columns == df.columns
    assert {r.doc_id for r in langid.keep(df, model).collect()} == {4, None, 5, 6}
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.fit(empty)).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, (1 << n - 2) if n <= 5 else 3)
    assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))


def test_ambiguity_is_flagged():
    counts = {lang: np.zeros(langid.BUCKETS) for lang in ("x", "y")}
    for lang, text in (("x", "aba abba baab"), ("y", "cdc cddc dccd")):
        counts[lang] += np.bincount(langid.ngrams(text * 20), minlength=langid.BUCKETS)
    _, score, ambiguous = langid.Model(counts).predict(["abba ab", "efe fef", "abba cddc"])
    assert not ambiguous[0] and ambiguous[1] and score[0] > 0.9 > score[1]


def test_quality_held_out(spark):
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(both) > 50 and np.mean([r.predicted == r.quality for r in both]) > 0.95
    assert rows.count() == 1000


def test_discriminant_against_densities():
    rng = np.random.default_rng(0)
    k = quality.N_STATISTICS
    x = {0: rng.normal(size=(500, k)), 1: rng.normal(size=(900, k)) * 2 + 1}
    model = quality.Discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    pooled = (np.cov(x[0].T) * 499 + np.cov(x[1].T) * 899) / 1398
    ridge = np.diag(quality.RIDGE * np.diag(pooled) + 1e-6)
    logs = []
    for c in (0, 1):
        s = (1 - quality.SHRINKAGE) * np.cov(x[c].T) + quality.SHRINKAGE * pooled + ridge
        d = x[1][:50] - x[c].mean(0)
        logs.append(np.log(len(x[c]) / 1400) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.scores(x[1][:50]), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep(df, model).columns == df.columns
    assert {r.score for r in quality.score(df, quality.fit(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels)).count() == 0


def brute_grams(text):
    """Buckets of the n-grams of runs of letters, one space around each, counted one by one."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    line = [ord(c) for c in " " + "".join(w + " " for w in words if w)]
    counts = Counter()
    for n in (1, 2, 3) if len(line) > 1 else ():
        for i in range(len(line) - n + 1):
            code = 0
            for k in range(n):
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ (line[i + k] + (k + 1) * 0x9E37)
            counts[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 17] += 1
    return counts


def test_langid_query_against_brute_force(spark, sf_dir):
    """The whole query from plain dictionaries: counts, classifiers of all ways to part the languages, their weights, decoding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    grams = {d.doc_id: brute_grams(d.text) for d in docs}
    train = [d for d in docs if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 5]
    langs = sorted({d.lang for d in train})
    counts = {x: sum((grams[d.doc_id] for d in train if d.lang == x), Counter()) for x in langs}
    share = lambda x, b: (counts[x][b] + 0.5) / (counts[x].total() + 0.5 * 32768)
    splits = [[1 if s >> i & 1 else -1 for i in range(len(langs))] for s in range(1, 1 << (len(langs) - 1))]
    seen = set().union(*grams.values())
    weight = [{b: math.log(np.mean([share(x, b) for x, w in zip(langs, split) if w > 0]) / np.mean([share(x, b) for x, w in zip(langs, split) if w < 0])) for b in seen} for split in splits]
    odds = {i: [sum(n * w[b] for b, n in g.items()) * min(g.total(), 300) / max(g.total(), 1) for w in weight] for i, g in grams.items()}
    lettered = [d for d in train if grams[d.doc_id]]
    trust = [max(0.05, 2 * np.mean([odds[d.doc_id][k] * split[langs.index(d.lang)] > 0 for d in lettered]) - 1) for k, split in enumerate(splits)]
    got = {r.doc_id: r for r in queries.op1_langid(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(langs) > 2
    for d in docs:
        loss = [sum(t * np.logaddexp(0, -o * split[j]) for t, o, split in zip(trust, odds[d.doc_id], splits)) * 2 / sum(trust) for j in range(len(langs))]
        likely = np.exp(min(loss) - np.array(loss))
        likely /= likely.sum()
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        if not grams[d.doc_id]:
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0, False)
        else:
            first, second = np.sort(likely)[::-1][:2]
            assert r.score == pytest.approx(first, abs=2e-3)
            assert first - second < 0.01 or r.lang_pred == langs[likely.argmax()]
            assert abs(first - second - langid.MARGIN) < 0.01 or r.ambiguous == (first - second < langid.MARGIN)


def brute_statistics(text):
    text = text or ""
    data, words, lines = text.encode(), text.split(), text.split("\n")
    odds = lambda part, whole: math.log((part + 0.5) / (max(whole, part) - part + 0.5))
    kind = Counter("A" if 65 <= b < 91 else "a" if 97 <= b < 123 else "x" if b >= 128 else "0" if 48 <= b < 58 else " " if b == 32 or 9 <= b < 14 else "." if b in b",." else "#" for b in data)
    shown, n = len(data) - kind[" "], len(words)
    return [math.log(n + 1), math.log((len(data) + 1) / (n + 1)), odds(len(set(words)), n), odds(kind["A"], shown), odds(kind["0"], shown), odds(kind["#"], shown), odds(kind["."], n + kind["."]),
            odds(max(Counter(words).values(), default=0), n), odds(len({(a, b) for a, b in zip(words, words[1:])}), max(n - 1, 0)), math.log(len(lines) / len(set(lines))), math.log((n + 1) / len(lines))]


def test_quality_query_against_brute_force(spark, sf_dir):
    """The whole query from plain statistics and densities by determinants and inverses."""
    docs = {d.doc_id: brute_statistics(d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in docs]
    rows = {c: np.array([docs[r.doc_id] for r in labels if r.quality == c]) for c in (0, 1)}
    own = {c: np.cov(x.T) for c, x in rows.items()}
    pooled = sum(own[c] * (len(x) - 1) for c, x in rows.items()) / (sum(map(len, rows.values())) - 2)
    cov = {c: 0.5 * own[c] + 0.5 * pooled + np.diag(1e-3 * np.diag(pooled) + 1e-6) for c in own}

    def density(x, c):
        away = x - rows[c].mean(0)
        return math.log(len(rows[c])) - 0.5 * np.linalg.slogdet(cov[c])[1] - 0.5 * away @ np.linalg.inv(cov[c]) @ away

    got = {r.doc_id: r for r in queries.op8_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs) and min(map(len, rows.values())) > 5
    for i, x in docs.items():
        want = 1 / (1 + math.exp(min(500, max(-500, density(x, 0) - density(x, 1)))))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == (got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
