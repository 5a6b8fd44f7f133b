"""A stored vector index: cells around centroids, in folders of their own, read only where a nearest vector can lie. Exact.

The centroids are fitted on a bounded sample on the driver; every vector is then put into the cell of its nearest centroid, with its distance to it. By the triangle inequality
no vector of a cell is nearer to a query than the distance to the centroid less the cell's radius. A search reads the cells nearest to each query until these hold k
vectors, which bounds the k-th distance, and then the cells whose bound reaches it; other folders aren't opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.retrieval import _first, nearest
from millrace.session import read_folders, scratch, write_folders

#: Cells, at most; vectors a cell, about, as long as there are fewer; sampled vectors for each cell, and rounds of the fit.
CELLS, PER_CELL, SAMPLE, ROUNDS = 1024, 256, 32, 8
#: Queries that are searched at a time; the driver and every task hold these with the centroids.
BLOCK = 2048


def fit_cells(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced rows of x; centroids that lose all their vectors stay where they are."""
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = nearest_cell(x, centroids)[0]
        n = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest_cell(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the number of a nearest centroid, and the distance to it."""
    of = ((centroids * centroids).sum(1) - 2 * x @ centroids.T).argmin(1)
    return of, np.sqrt(((x - centroids[of]) ** 2).sum(1))


def _finite(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & (F.abs(e) < float("inf"))))


class VectorIndex:
    """`build` writes an index, the constructor opens a written one. `rows_read` counts the rows that searches have read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows_read = spark, path, spark.sparkContext.accumulator(0)
        self.vectors = read_folders(spark, f"{path}/vectors")
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()  # CELLS at most
        self.cells = cells["cell"].to_numpy()
        self.n, self.radius = cells["n"].to_numpy(), cells["radius"].to_numpy(float)
        self.centroids = np.array(cells["centroid"].tolist(), float)

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> "VectorIndex":
        """Vectors of one length; null ones and those with a component that is null or not finite take no part. Further columns are kept for filters."""
        spark = vectors.sparkSession
        path = path or scratch(spark, "vectors")
        rest = [c for c in vectors.columns if c not in (id_col, vector_col)]
        held = _finite(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *rest), "v")
        cells = max(1, min(CELLS, held.count() // PER_CELL))
        sample = held.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE).toPandas()
        centroids = fit_cells(np.array(sample["v"].tolist(), float), cells) if len(sample) else np.zeros((1, 1))

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                cell, apart = nearest_cell(np.stack(pdf["v"].to_numpy()).astype(float), centroids)
                yield pdf.assign(cell=cell.astype(np.int32), apart=apart)

        dealt = held.mapInPandas(put, T.StructType([*held.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("apart", T.DoubleType())]))
        # ranges by cell, distance and id: a cell with very many vectors is written by many tasks
        write_folders(dealt.repartitionByRange("cell", "apart", "id"), f"{path}/vectors", "cell")
        middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        if not len(sample):
            middle = middle.limit(0)
        found = read_folders(spark, f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
        found.join(middle, "cell").write.parquet(f"{path}/cells")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """query_id, rank, id and distance (squared L2) of each query's k nearest vectors of those that `where` holds for; ties to the smaller id.

        Queries (query_id, vector) are taken in blocks; vectors that could take no part have no results. Query ids are unique.
        """
        asked = _finite(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "vector")
        out, block = None, []
        for row in asked.toLocalIterator():
            block.append(row)
            if len(block) == BLOCK:
                found = self._block(block, asked.schema["query_id"].dataType.simpleString(), k, where)
                out, block = found if out is None else out.unionByName(found), []
        if block or out is None:
            found = self._block(block, asked.schema["query_id"].dataType.simpleString(), k, where)
            out = found if out is None else out.unionByName(found)
        return out

    def _block(self, block: list, id_type: str, k: int, where: Column | None) -> DataFrame:
        names = np.array([r.query_id for r in block], object)
        q = np.array([r.vector for r in block], float)
        if not len(block) or not len(self.cells):
            away = np.zeros((len(block), len(self.cells)))
        else:
            away = np.sqrt(((q[:, None, :] - self.centroids[None]) ** 2).sum(2)) if q.size * len(self.cells) < 1 << 22 else np.stack([np.sqrt(((self.centroids - v) ** 2).sum(1)) for v in q])
        least = np.maximum(away - self.radius, 0) * (1 - 1e-9) - 1e-9  # rounding must not hide a vector
        order = np.argsort(away, axis=1)
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        early = np.zeros(away.shape, bool)
        np.put_along_axis(early, order, before < k, axis=1)
        first = self._meet(early, q, k, where).toPandas()  # k rows a query at most
        limit = np.full(len(block), np.inf)
        for at, own in first.groupby("row"):
            if len(own) >= k:
                limit[at] = own["distance"].max()
        later = ~early & ~(np.where(least > 0, least, 0) ** 2 > limit[:, None])
        schema = f"row int, id {self.vectors.schema['id'].dataType.simpleString()}, distance double"
        both = self.spark.createDataFrame(first, schema) if len(first) else self.spark.createDataFrame([], schema)
        if later.any():
            both = both.unionByName(self._meet(later, q, k, where))
        named = self.spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"row int, query_id {id_type}")
        rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "id"))
        return both.withColumn("rank", rank).where(F.col("rank") <= k).join(named, "row").select("query_id", "rank", "id", "distance")

    def _meet(self, wanted: np.ndarray, q: np.ndarray, k: int, where: Column | None) -> DataFrame:
        """(row, id, distance): each task's k best of the cells that each query wants; only their folders are listed."""
        asking = {int(c): np.flatnonzero(wanted[:, i]) for i, c in enumerate(self.cells) if wanted[:, i].any()}
        read = self.vectors.where(F.col("cell").isin(list(asking)))
        read = (read if where is None else read.where(where)).select("cell", "id", "v")
        seen = self.rows_read

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for pdf in batches:
                seen.add(len(pdf))
                for cell, own in pdf.groupby("cell"):
                    rows = asking[int(cell)]
                    row, ids, distance = nearest(q[rows], np.stack(own["v"].to_numpy()).astype(float), own["id"].to_numpy(), k)
                    now = rows[row], ids, distance
                    best = now if best is None else _first(*(np.concatenate(x) for x in zip(best, now)), k)
            if best is not None:
                yield pd.DataFrame({"row": best[0].astype(np.int32), "id": best[1], "distance": best[2]})

        per_task = read.mapInPandas(run, f"row int, id {self.vectors.schema['id'].dataType.simpleString()}, distance double")
        rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "id"))
        return per_task.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
