"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, drop


#: Links, about, that one task of a step handles; a step over few links has few tasks, whatever spark.sql.shuffle.partitions is.
PART = 200_000


def _written(df: DataFrame, name: str, parts: int | None) -> DataFrame:
    return cut(df.coalesce(parts) if parts else df, name)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links` that is not the smallest of its component; root is the smallest.

    Links are pairs of longs, in any order, repeats and self-links allowed; a link with a null is none.
    Each step reads written tables only, so that adaptive execution can split the rows of a node with
    very many links, and an executor's loss costs one step at most. What a step has read is deleted. Nothing is collected.
    Steps never add links, and every round lowers some link until all links are stars around their smallest node: no node then has two
    smaller neighbours, or both a smaller and a larger one.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, parts = cut(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        least = _written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), smaller.alias("smaller"), larger.alias("larger")), "least", parts)
        count, not_star = least.agg(F.coalesce(F.sum("smaller"), F.lit(0)), F.count_if(F.expr("smaller > 1 or smaller = 1 and larger > 0"))).first()
        if not not_star:
            drop(least)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        parts = -(-count // PART)
        large = both.join(least.select("u", "m").hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _written(large.where("u <> v").distinct(), "large", parts)
        lower = _written(large.groupBy("u").agg(F.min("v").alias("m")), "least", parts)
        small = large.join(lower.hint("merge"), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        after = _written(small.select("e.u", "e.v").where("u <> v").distinct(), "links", parts)
        drop(edges, least, large, lower)
        edges = after
