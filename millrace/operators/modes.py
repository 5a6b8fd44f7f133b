"""Search modes: how vector search, keywords, fusion and reranking are put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.operators.embed import Encoder, embed
from millrace.operators.inverted import InvertedIndex


@dataclass(frozen=True)
class Mode:
    """Hits of each search, hits after reranking (0: none), variants of a question."""

    hits: int
    best: int
    rerank: bool = True
    keywords: bool = True
    variants: int = 1


MODES = {"fast": Mode(5, 3, rerank=False, keywords=False), "standard": Mode(8, 3), "deep": Mode(10, 5, variants=3)}
#: Hits, at most, that the variants of one question bring together; characters that tell hits apart.
GATHERED, HEAD = 15, 80


def without_noise(x: Column, noise: list[str]) -> Column:
    """A question without phrases that say nothing of its subject, blanks evened."""
    for pattern in noise:
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def variants(questions: DataFrame, rewrites: list[Callable[[Column], Column]], n: int = 3) -> DataFrame:
    """query_id, variant and text: the question and its rewrites that differ from it and each other, n at most."""
    forms = F.array(F.col("text"), *(r(F.col("text")) for r in rewrites))
    kept = F.slice(F.array_distinct(F.filter(forms, lambda f: F.length(F.trim(f)) > 0)), 1, n)
    return questions.select("query_id", F.posexplode(kept).alias("variant", "text"))


def search(docs: DataFrame, questions: DataFrame, mode: Mode, encoder: Encoder, scorer: Callable[[pd.Series, pd.Series], pd.Series], rewrites: list[Callable[[Column], Column]] = (), index: InvertedIndex | None = None) -> DataFrame:
    """query_id, rank, id, text and source of each question's best hits.

    docs: doc_id, text, source, embedding. Keywords are looked up in `index`, or in one that is built for this search. Hits of a question's variants come in order of variant and rank, those with equal first
    HEAD characters once, GATHERED at most. Empty questions have no hits.
    """
    asked = questions.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    forms = variants(asked, list(rewrites), mode.variants).withColumn("form_id", F.concat_ws(":", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    as_queries = forms.select(F.col("form_id").alias("query_id"), "text")
    vectors = embed(as_queries, "text", encoder, "vector")
    hits = retrieval.vector_search(docs, vectors, mode.hits, "doc_id").select("query_id", "id", "rank")
    if mode.keywords:
        hits = retrieval.fuse([hits, (index or InvertedIndex.build(docs)).search(as_queries, 20).select("query_id", "id", "rank")], mode.hits)
    found = hits.select(F.col("query_id").alias("form_id"), "id", F.col("rank").alias("form_rank")).join(forms.select("form_id", "query_id", "variant"), "form_id")
    found = retrieval.with_documents(found, docs.select("doc_id", "text", "source"))
    first = found.groupBy("query_id", F.substring("text", 1, HEAD).alias("head")).agg(F.min(F.struct("variant", "form_rank", "id", "text", "source")).alias("h"))
    order = Window.partitionBy("query_id").orderBy("h.variant", "h.form_rank", "h.id")
    gathered = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (GATHERED if mode.variants > 1 else mode.hits))
    gathered = gathered.select("query_id", "rank", "h.id", "h.text", "h.source")
    if not mode.rerank:
        return gathered.where(F.col("rank") <= mode.best)
    with_question = gathered.join(asked.select("query_id", F.col("text").alias("question")), "query_id")
    best = retrieval.rerank(with_question, scorer, mode.best)
    return best.select("query_id", F.col("rerank").alias("rank"), "id", "text", "source")


def evaluate(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Questions, share of them with a relevant hit, with it first, and mean precision, over all questions of `relevant` (query_id, id)."""
    marked = hits.where(F.col("rank") <= k).join(relevant.withColumn("good", F.lit(1)), ["query_id", "id"], "left")
    per = marked.groupBy("query_id").agg(F.max(F.coalesce("good", F.lit(0))).alias("hit"), F.max(F.when(F.col("rank") == 1, F.coalesce("good", F.lit(0)))).alias("first"), F.avg(F.coalesce("good", F.lit(0))).alias("precision"))
    every = relevant.select("query_id").distinct().join(per, "query_id", "left").na.fill(0)
    return every.agg(F.count("*").alias("questions"), F.avg("hit").alias("hit_rate"), F.avg("first").alias("top1"), F.avg("precision").alias("precision"))
