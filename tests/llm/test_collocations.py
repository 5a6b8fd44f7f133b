import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import collocations, queries
from tests.oracle import assert_matches

SCHEMA = "lang string, text string, phrase string, a int"


def brute(rows, max_n=3, min_count=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        frequent, found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}, []
        for p, a in frequent.items():
            if any(100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], SCHEMA)
    return sorted(map(tuple, collocations.mine(docs, **how).collect()))


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op11_collocations, collocations.SQL, sf_dir)


def test_against_brute_force(spark):
    rng, rows = random.Random(7), []
    for _ in range(300):
        words = rng.choices(["New", "york", "São", "paulo", "ÉTÉ", "a", "b", "$", "#", "x-y", "city"], [9, 9, 5, 5, 3, 8, 8, 1, 1, 2, 6], k=rng.randint(0, 40))
        words = [w + rng.choice(["", "", "", "", " new york city", ".", "\n", "\t", "\x0b", ";;"]) for w in words]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, max_n=4, min_count=5, covered=80, top=15) == brute(rows, 4, 5, 80, 15)
    assert mined(spark, rows, max_n=2, min_count=3) == brute(rows, 2, 3)


def test_odd_texts(spark):
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t "), ("en", "...\n"), ("en", "a b " * 50_000), ("de", "a b"), *[("fr", "eins zwei")] * 12, ("xx", "tie one " * 11), ("xx", ". two tie" * 11)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []


def test_exact_scores(spark):
    cases = [(10**15, 10**15, 10**15), (999_999_999_999_989, 999_999_999_999_990, 10**15 + 7), (2**33 + 1, 2**40, 2**35), (10, 10, 11), (10, 3_000_000, 4_000_000)]
    df = spark.createDataFrame(cases, "a long, l long, r long").withColumn("score", collocations.exact_score(F.col("a"), F.col("l"), F.col("r")))
    assert [r.score for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in cases]


def test_only_frequent_phrases_are_written(spark):
    docs = spark.createDataFrame([("en", "rare pair"), *[("en", "often seen")] * 10], "lang string, text string")
    assert sorted((r.phrase, r.f) for r in collocations.counted(docs, (1, 2), 10).collect()) == [("often", 10), ("often seen", 10), ("pair", 1), ("rare", 1), ("seen", 10)]


def test_only_ascii_is_lowered(spark):
    texts = ["ABC é", "É Abc", "Σ ΑΣ x", "İstanbul ŞI", "Ⅰ Ⓐ A", "ǅ Z", "plain", "日本 Z", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", collocations.lowered(F.col("t")).alias("low"))
    assert all(r.low == "".join(c.lower() if "A" <= c <= "Z" else c for c in r.t) for r in df.collect())


def test_one_row_a_place(spark):
    docs = spark.createDataFrame([("en", "a b  c.d"), ("en", "a\tb"), ("en", " . "), (None, "x"), ("en", None)], "lang string, text string")
    keys = lambda *n: sorted(r.key for r in collocations.windows(docs, *n).collect())
    assert keys(1, 2) == ["a b\nen", "a b\nen", "b\nen", "b c\nen", "c\nen", "d\nen", "x\nund"]
    assert keys(3, 3) == ["a b c\nen"]


def test_keys_are_made_in_compiled_code(spark):
    docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for lengths in [(1, 2), (3,)]:
            plan = collocations.counted(docs, lengths, 10)._jdf.queryExecution().executedPlan().toString().splitlines()
            made = [line for line in plan if re.search(r"\bGenerate ", line)]
            assert made and all(re.search(r"\*\(\d+\) Generate ", line) and "lambda" not in line for line in made)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lengths_counted_together(spark):
    rng, langs = random.Random(3), ["en", "zh Hant", "a\nb c", "", None]
    rows = [(rng.choice(langs), " ".join(rng.choice(["a", "b", "cc", "d.", "é"]) for _ in range(rng.randint(0, 30)))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    true = Counter()
    for lang, text in rows:
        for piece in text.split("."):
            words = piece.split()
            true.update(("und" if lang is None else lang, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    for lengths in [(1,), (1, 2), (3,), (1, 2, 3), (2, 3), (1, 3)]:
        got = sorted((r.lang, r.phrase, r.f) for r in collocations.counted(docs, lengths, 25).collect())
        assert got == sorted((lang, p, f) for (lang, p), f in true.items() if len(p.split()) in lengths and (f >= 25 or " " not in p))
