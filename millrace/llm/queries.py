"""The thin queries over the operators, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, collocations, embedding, langid, licenses, lm, mixing, mtree, packing, quality, search, simhash, urlfilter
from millrace.llm.common import crc_mod, cut, table


def tokenizer() -> tuple[str, str]:
    """The public byte-level tokenizer's file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
"""


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: Hosts with paths, and what happens to what lies under them.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

OP7_SQL = r"""
WITH rules(rule, verdict) AS (VALUES ('com/','allow'),('example.com/en/','block'),('www.example.com/en/','allow'),('net/es/','block'),('net/fr/','block')),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
      FROM p JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
        AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return lm.score(docs, crc_mod("doc_id", 10) != 0).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 4) != 2))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=2048, end_id=1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), max_n=3, min_count=10, covered=50, top=2000)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(chat.PLANTED).alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.render(chat.fold(chat.turn_log(talks))))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.Index(table(spark, sf_dir, "documents"))
    return index.top_k(table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run, "op1_langid": op1_langid, "op2_mixing": op2_mixing, "op3_mtree": op3_mtree, "op4_embedding": op4_embedding, "op5_licenses": op5_licenses, "op6_lm": op6_lm, "op7_urlfilter": op7_urlfilter, "op8_quality": op8_quality, "op9_packing": op9_packing, "op10_simhash": op10_simhash, "op11_collocations": op11_collocations, "op12_chat": op12_chat, "op13_search": op13_search}


def oracle_sql() -> dict[str, str]:
    return {"op3_mtree": OP3_SQL, "op4_embedding": OP4_SQL, "op5_licenses": licenses.brute_sql(), "op7_urlfilter": OP7_SQL, "op11_collocations": collocations.SQL, "op12_chat": chat.SQL, "op13_search": search.SQL}
