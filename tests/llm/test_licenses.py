import random

from millrace.llm import licenses, queries
from tests.oracle import assert_matches

SCHEMA = "doc_id long, text string, license string, words int"


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op5_licenses, licenses.brute_sql(), sf_dir)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op5_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def brute(text):
    own = licenses.words(text or "")
    shingles = [" ".join(own[i : i + 5]) for i in range(len(own) - 4)]
    out = {}
    for name, notice in licenses.NOTICES.items():
        t = licenses.words(notice)
        wanted = {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
        window, step = licenses.geometry(len(t))
        best = max((len(wanted & set(shingles[i : i + window - 4])) / len(wanted) for i in range(0, max(len(shingles), 1), step)), default=0)
        if best >= licenses.CONTAINMENT:
            out[name] = best
    return out


def test_against_brute_force(spark):
    rng, rows = random.Random(1), []
    for i in range(150):
        body = [rng.choice(["alpha", "beta", "license", "granted", "the", "under"]) for _ in range(rng.randint(0, 120))]
        notice = rng.choice(list(licenses.NOTICES.values())).split(" ")
        if i % 3 == 0:
            notice[rng.randrange(len(notice))] = "other"
        at = rng.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + notice + body[at:]), "x", 1))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "license", "x", 1), (903, "w " * 50_000 + "RELEASED under the MIT license", "x", 1), (904, rows[1][1], "x", 1), (904, rows[1][1], "x", 1)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    assert got == {i: found for i, t, *_ in rows if (found := brute(t))}
    assert any(x < 1 for f in got.values() for x in f.values())
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_keep_their_promise():
    for n in range(5, 60):
        own, held = n - 4, licenses.geometry(n)[0] - 4
        common = -(-4 * own // 5)
        j = common / (own + held - common)
        assert (1 - j) ** licenses.bands(n) <= licenses.MISS * 1.0001
