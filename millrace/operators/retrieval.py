"""Vector and keyword search, rank fusion, reranking and contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.inverted import InvertedIndex, Weights
from millrace.session import sent, stored

#: Queries of one block, and of the largest set that goes to every task as it is; vectors of a shard, about.
QUERY_BLOCK, SENT_QUERIES, SHARD = 512, 2048, 8192
#: Pairs that are compared exactly at once.
EXACT_PAIRS = 100_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def _first(row: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's (id, distance), the k of least distance; ties to the smaller id."""
    order = np.lexsort((ids, distance, row))
    row, ids, distance = row[order], ids[order], distance[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], distance[place < k]


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, squared distance) of the k vectors of x nearest to each row of q.

    Distances by products leave out what can't be among the k nearest, with a bound for their rounding; the others are compared exactly.
    """
    found = []
    for at in range(0, len(q), QUERY_BLOCK):
        block = q[at : at + QUERY_BLOCK]
        of_q, of_x = (block * block).sum(1)[:, None], (x * x).sum(1)[None, :]
        near = of_q - 2 * block @ x.T + of_x
        slack = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (of_q + of_x)
        limit = np.partition(near + slack, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.inf
        row, column = np.nonzero(~(near - slack > limit))  # what is not a number stays
        cuts = np.searchsorted(row, np.arange(len(block) + 1))
        first = 0
        while first < len(block):  # whole rows, about EXACT_PAIRS at a time
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + EXACT_PAIRS, "right")) - 1)
            r, c = row[cuts[first] : cuts[last]], column[cuts[first] : cuts[last]]
            exact = np.concatenate([((x[c[i : i + EXACT_PAIRS]] - block[r[i : i + EXACT_PAIRS]]) ** 2).sum(1) for i in range(0, len(r), EXACT_PAIRS)] or [np.zeros(0)])
            r, held, exact = _first(r, ids[c], exact, k)
            found.append((r + at, held, exact))
            first = last
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), ids[:0], np.zeros(0))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and distance (squared L2) of each query's k nearest vectors; ties to the smaller id.

    A stated set of queries meets all vectors. Up to SENT_QUERIES queries go to every task as they are; more are dealt to blocks, each of which
    meets every shard of the vectors. A task keeps k a query, and a window merges them.
    """
    held = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, distance double"
    first = asked.limit(SENT_QUERIES + 1).toPandas()
    if len(first) <= SENT_QUERIES:
        sent = vectors.sparkSession.sparkContext.broadcast((first["query_id"].to_numpy(), np.array(first["vector"].tolist(), float)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best = None
            for pdf in batches:
                if len(pdf) and len(ids):
                    now = nearest(q, np.stack(pdf["v"].to_numpy()).astype(float), pdf["id"].to_numpy(), k)
                    best = now if best is None else _first(*(np.concatenate(x) for x in zip(best, now)), k)
            if best is not None:
                yield pd.DataFrame({"query_id": ids[best[0]], "id": best[1], "distance": best[2]})

        per_task = held.mapInPandas(run, schema)
    else:
        n, m = asked.count(), held.count()
        shards, blocks = -(-m // SHARD), -(-n // SENT_QUERIES)
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1)))
        dealt = held.select(F.pmod(F.xxhash64("id"), F.lit(max(shards, 1))).cast("int").alias("shard"), every(blocks).alias("block"), "id", "v")
        asking = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "vector")

        def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(q):
                return pd.DataFrame({"query_id": [], "id": [], "distance": []})
            row, ids, distance = nearest(np.stack(q["vector"].to_numpy()).astype(float), np.stack(x["v"].to_numpy()).astype(float), x["id"].to_numpy(), k)
            return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "id": ids, "distance": distance})

        per_task = dealt.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return per_task.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def bm25(docs: DataFrame, queries: DataFrame, k: int | None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, id and score of each query's k best documents (all: None), by an index that is built for this search; ties to the smaller id.

    Terms that a query repeats count as often. For more than one search, build an `InvertedIndex` and keep it.
    """
    return InvertedIndex.build(docs, None, id_col, text_col).search(queries, k, Weights(k1, b, epsilon))


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: each list adds 1 / (constant + rank); a document that a list has twice adds twice."""
    both = rankings[0].select("query_id", "id", "rank")
    for other in rankings[1:]:
        both = both.unionByName(other.select("query_id", "id", "rank"))
    scores = both.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def with_documents(hits: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits (with an `id`) and what `docs` has for them. Few hits go to the documents, so that whole tables of texts aren't shuffled for these."""
    hits = stored(hits, "hits")
    return docs.withColumnRenamed(id_col, "id").join(sent(hits, hits), "id")


def rerank(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int, question: str = "question", text: str = "text") -> DataFrame:
    """The k best hits of each query by a scorer of (question, text) pairs, larger better; ties to the earlier rank."""
    scorer = F.pandas_udf(score, "double")
    scored = hits.withColumn("rerank_score", scorer(F.col(question), F.col(text)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return scored.withColumn("rerank", place).where(F.col("rerank") <= k)


def fallback_order(hits: DataFrame, k: int, larger_is_better: bool = True) -> DataFrame:
    """Without a scorer: fused scores from the largest, distances from the smallest."""
    order = F.desc("score") if larger_is_better else F.asc("score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return hits.withColumn("rerank", place).where(F.col("rerank") <= k)


def contexts(hits: DataFrame, text: str = "text", source: str = "source", n: int = 300) -> DataFrame:
    """query_id and context: numbered sections of each query's hits, in order of rank, each of n characters at most."""
    section = lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), s["source"], F.lit("\n"), F.substring(s["text"], 1, n))
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col(source).alias("source"), F.col(text).alias("text"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, section), "\n\n").alias("context"))


def keyword_score(title: Column, tags: Column, words: Column) -> Column:
    """2 for each word in the title and 1.5 for each tag that contains one."""
    in_title = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(F.contains(F.lower(title), w), 2.0).otherwise(0.0))
    in_tags = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(F.exists(tags, lambda t: F.contains(F.lower(t), w)), 1.5).otherwise(0.0))
    return in_title + in_tags


def similarity_pct(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 10) * 100


def normalised(distance: Column) -> Column:
    """1 / (1 + d): falls with the distance over its whole range."""
    return 1 / (1 + F.abs(distance))
