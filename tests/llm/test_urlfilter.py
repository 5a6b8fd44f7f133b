import numpy as np

from millrace.llm import queries, urlfilter
from tests.oracle import assert_matches

RULES = queries.URL_RULES


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:at], rest[at:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES[rule] if rule else "allow"


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op7_urlfilter, queries.OP7_SQL, sf_dir)


def test_odd_urls(spark):
    urls = [None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/en/?q", "http://xexample.com/en/", "http://a.example.com/en/", "http://a.example.com/en", "http://net/es/#x", "http://a.net?x/es/", "http://ä.com/", "http://com", "http://.com/" + "y" * 50_000, "http://a.net/fr/1", "http://a.net/fr/1", "http://" + "a." * 30_000 + "www.example.com/en/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "1 as host", "'x' as rule", "2 as keys")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_cascade_is_exact(spark):
    """Many rules and a level with many errors."""
    keys = [f"h{i}.com/" for i in range(20_000)]
    rules = keys[::7]
    universe = spark.createDataFrame([(k,) for k in keys], "key string").select(*urlfilter._hashes(urlfilter.F.col("key")), "key")
    levels = urlfilter.build_cascade(universe.select("h1", "h2"), rules)
    pdf = universe.toPandas()
    listed = urlfilter.in_cascade(levels, pdf.h1.to_numpy(), pdf.h2.to_numpy())
    assert len(levels) > 2 and set(pdf.key[np.flatnonzero(listed)]) == set(rules)


def test_the_result_can_be_filtered(spark, sf_dir):
    rows = queries.op7_urlfilter(spark, sf_dir).collect()
    want = sum(r.rule is not None for r in rows), sum(r.verdict == "block" for r in rows)
    assert min(want) > 0
    for _ in range(5):
        out = queries.op7_urlfilter(spark, sf_dir)
        assert (out.where("rule is not null").count(), out.where("verdict = 'block'").count()) == want
