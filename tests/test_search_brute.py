"""The queries of reranking and of the search modes, whole, against plain Python over DuckDB's BM25."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from millrace.operators import embed, modes
from millrace.plans import catalog
from millrace.plans.texts import BM25


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    con.execute(f"CREATE TABLE benchmark AS SELECT * FROM read_parquet('{sf_dir}/benchmark.parquet')")
    docs = {i: (t, s) for i, t, s in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    return con, docs, dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())


def keywords(con, texts, k):
    """(text's key, [ids by rank]) by SQL, for any texts."""
    con.execute("CREATE OR REPLACE TABLE benchmark (item_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(texts.items()))
    out = defaultdict(list)
    for q, i in con.execute(f"WITH {BM25} SELECT query_id, id FROM b WHERE rank <= {k} ORDER BY query_id, rank").fetchall():
        out[q].append(i)
    return out


def overlap(question, text):
    words = set(question.lower().split())
    return len(words & set(text.lower().split())) / max(len(words), 1)


def test_rerank(spark, sf_dir, tables):
    con, docs, items = tables
    hits, want = keywords(con, {str(i): t for i, t in items.items()}, 15), []
    for item, text in items.items():
        ranked = sorted((-overlap(text, docs[d][0]), rank + 1, d) for rank, d in enumerate(hits[str(item)]))[:3]
        want += [(item, place + 1, rank, d, round(-s, 6)) for place, (s, rank, d) in enumerate(ranked)]
    got = catalog.queries()["ret07_rerank"](spark, sf_dir).collect()
    assert sorted((r.query_id, r["rerank"], r["rank"], r.id, r.rerank_score) for r in got) == sorted(want) != []


@pytest.mark.parametrize("name", ["fast", "standard", "deep"])
def test_modes(spark, sf_dir, tables, name):
    con, docs, items = tables
    mode, encode = modes.MODES[name], embed.hashed_words()()
    ids = np.array(sorted(docs))
    held = encode(np.array([docs[i][0] for i in ids], object)).astype(float)
    rewrites = [lambda x: re.sub(r"\s+", " ", re.sub(r"\b(?:the|of|and)\b", " ", x)).strip(), lambda x: " ".join(x.split(" ")[:6]).lower()]
    forms = {}
    for item, text in items.items():
        kinds = list(dict.fromkeys([text, *(f(text) for f in rewrites)]))[: mode.variants]
        forms.update({f"{item}:{v}": t for v, t in enumerate(kinds)})
    by_words = keywords(con, forms, 20) if mode.keywords else {}
    want = []
    for item, text in items.items():
        seen, gathered = set(), []
        for v in range(mode.variants):
            if f"{item}:{v}" not in forms:
                continue
            distance = ((held - encode(np.array([forms[f"{item}:{v}"]], object)).astype(float)) ** 2).sum(1)
            near = [int(ids[i]) for i in np.lexsort((ids, distance))[: mode.hits]]
            if mode.keywords:
                score = defaultdict(float)
                for ranking in (near, by_words[f"{item}:{v}"]):
                    for rank, d in enumerate(ranking):
                        score[d] += 1 / (61 + rank)
                near = [d for _, d in sorted((-round(s, 9), d) for d, s in score.items())][: mode.hits]
            for d in near:
                if (head := docs[d][0][: modes.HEAD]) not in seen:
                    seen.add(head)
                    gathered.append(d)
        gathered = gathered[: modes.GATHERED if mode.variants > 1 else mode.hits]
        if mode.rerank:
            gathered = [d for _, _, d in sorted((-overlap(text, docs[d][0]), rank, d) for rank, d in enumerate(gathered))]
        want += [(item, place + 1, d, docs[d][1]) for place, d in enumerate(gathered[: mode.best])]
    query = {"fast": "ret09_fast_mode", "standard": "ret10_standard_mode", "deep": "ret11_deep_mode"}[name]
    got = sorted((r.query_id, r["rank"], r.id, r.source) for r in catalog.queries()[query](spark, sf_dir).collect())
    assert got == sorted(want) != []
