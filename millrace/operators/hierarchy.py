"""Chains of parents: version histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chains(df: DataFrame, node: str, parent: str, longest: int = 100) -> DataFrame:
    """id, root and depth (1 for a root) of every node that hangs from a root within `longest` steps; nodes of cycles have none.

    A root has no parent, or one that isn't in the table. The recursion is Spark's own.
    """
    nodes = df.select(F.col(node).alias("id"), F.col(parent).alias("parent"))
    name = f"millrace_chain_{id(df)}"
    nodes.createOrReplaceTempView(name)
    return df.sparkSession.sql(f"""
        WITH RECURSIVE walk(id, root, depth) MAX RECURSION LEVEL {longest} AS (
          SELECT n.id, n.id, 1 FROM {name} n LEFT ANTI JOIN {name} p ON n.parent = p.id
          UNION ALL
          SELECT n.id, w.root, w.depth + 1 FROM walk w JOIN {name} n ON n.parent = w.id WHERE w.depth < {longest})
        SELECT id, root, depth FROM walk""")
