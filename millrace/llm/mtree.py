"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, floor(1024 x). The largest inner products are the smallest distances once every vector x
gets one more component, sqrt(M^2 - |x|^2) with M the largest length, and every query a zero there: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x. The candidates are dealt to cells, each to its nearest pivot, and a cell's to shards by hash; each
shard is a tree of pages, bulk-loaded and written as a table: an entry of a page has its distance to the page's routing vector and,
in inner pages, a covering radius. A query first searches one shard of the cell that promises most. Its k-th score then rules out
cells by their pivots and covering radii, and only the shards of the others are sent the query. It visits the pages of a shard by their
upper bound of the score and stops when that is below its k-th score; the stored distances rule out entries by the
triangle inequality before their own distance is computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, drop
from millrace.llm.embedding import usable

#: Vectors of a shard, about, and queries that one task answers; entries of a page; pages that an inner page routes to.
SHARD, QUERIES, PAGE, FANOUT = 8192, 1024, 512, 16
#: Components of a shard, about: shards of long vectors hold fewer of them.
SHARD_VALUES = 1 << 21
#: Pivots of one vector length at most, and components of all pivots together: 16 MB are broadcast at most. So many times more vectors are drawn to choose them from.
PIVOTS, PIVOT_VALUES, DRAWN = 4096, 1 << 21, 4
SCALE = 1024
#: The least score there is: no score to reach yet.
NONE = -(1 << 63)

PAGES = "dim int, cell int, part int, page int, leaf boolean, ids array<long>, vectors array<long>, to_parent array<double>, radii array<double>, children array<int>, longest double"


def _exact(dim: int, largest: float) -> bool:
    """Whether double precision holds every inner product exactly."""
    return dim * float(largest) ** 2 < 1 << 53


def dots(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by whole numbers of any size where doubles are too small, kept to the range of a long."""
    if _exact(len(query), max(np.abs(vectors).max(initial=0), np.abs(query).max(initial=0))):
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    sums = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> list[dict]:
    """The pages of one tree, the root first. Deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    longest = float(np.sqrt(squares.max()))
    points = np.column_stack((vectors.astype(np.float64), np.sqrt(np.maximum(longest**2 - squares, 0))))
    pages: list[dict] = []

    def load(rows: np.ndarray, centre: np.ndarray) -> tuple[int, float]:
        """Adds the page of these rows; gives its number and covering radius around its routing vector."""
        number = len(pages)
        pages.append({})
        away = np.linalg.norm(points[rows] - centre, axis=1)
        if len(rows) <= PAGE:
            pages[number] = {"leaf": True, "ids": ids[rows], "vectors": vectors[rows].ravel(), "to_parent": away, "radii": np.zeros(0), "children": np.zeros(0, np.int32)}
            return number, float(away.max(initial=0))
        pivots = rng.choice(rows, min(FANOUT, len(rows)), replace=False)
        to_pivots = ((points[rows] ** 2).sum(1)[:, None] - 2 * points[rows] @ points[pivots].T + (points[pivots] ** 2).sum(1)[None, :])
        nearest = to_pivots.argmin(1)
        groups = [rows[nearest == k] for k in range(len(pivots))]
        if max(map(len, groups)) > 0.9 * len(rows):  # many equal vectors: no pivot parts them
            groups = np.array_split(rows, len(pivots))
        kept = [(p, g) for p, g in zip(pivots, groups) if len(g)]
        made = [load(g, points[p]) for p, g in kept]
        at = np.array([p for p, _ in kept])
        pages[number] = {"leaf": False, "ids": ids[at], "vectors": vectors[at].ravel(), "to_parent": np.linalg.norm(points[at] - centre, axis=1), "radii": np.array([r for _, r in made]), "children": np.array([c for c, _ in made], np.int32)}
        return number, float(away.max(initial=0))

    load(np.arange(len(ids)), points.mean(0))
    for p in pages:
        p["longest"] = longest
    return pages


class Tree:
    """A shard's pages, ready to search."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        pages = pages.sort_values("page")
        self.longest = float(pages.longest.iloc[0])
        self.pages = []
        for p in pages.itertuples():
            vectors = np.asarray(p.vectors, np.int64).reshape(-1, dim)
            self.pages.append((p.leaf, np.asarray(p.ids, np.int64), vectors, vectors.astype(np.float64), np.asarray(p.to_parent, np.float64), np.asarray(p.radii, np.float64), np.asarray(p.children, np.int64)))
        self.largest = max(float(np.abs(p[3]).max(initial=0)) for p in self.pages)
        #: Scores and distances computed so far.
        self.computed = 0

    def search(self, own: int, query: np.ndarray, k: int, floor: int = NONE) -> list[tuple[int, int]]:
        """The k best (score, id) of other ids with a score of `floor` or more; ties to the smaller id."""
        q = query.astype(np.float64)
        square = q @ q + self.longest**2
        exact = _exact(len(q), max(self.largest, np.abs(q).max()))
        slack = 1e-7 * square + 0.5  # scores are whole numbers; a distance is rounded by up to 1e-8 of the longest
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        queue = [(-np.inf, 0, np.nan)]  # minus the upper bound, page, distance to its routing vector
        while queue:
            bound, number, away = heapq.heappop(queue)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if least > NONE and -bound + slack < least:
                break
            leaf, ids, vectors, floats, to_parent, radii, children = self.pages[number]
            near = slice(None)
            if away == away and least > NONE:
                # |d(q, parent) - d(parent, entry)| - radius is no more than the distance to anything below the entry.
                low = np.maximum(np.abs(away - to_parent) - (0 if leaf else radii), 0)
                near = np.flatnonzero((square - low * low) / 2 + slack >= least)
                if not len(near):
                    continue
            self.computed += len(ids[near])
            if leaf:
                scores = (floats[near] @ q).astype(np.int64) if exact else dots(vectors[near], query)
                if least > NONE:
                    good = np.flatnonzero(scores >= least)
                    scores, found = scores[good], ids[near][good]
                else:
                    found = ids[near]
                for score, i in zip(scores.tolist(), found.tolist()):
                    if i != own and (len(best) < k or (score, -i) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -i))
            else:
                inner = floats[near] @ q
                # |q - p|^2 with the components that make lengths equal: 0 for the query, what p lacks to the longest.
                distances = np.sqrt(np.maximum(square - 2 * inner, 0))
                low = np.maximum(distances - radii[near], 0)
                upper = (square - low * low) / 2
                for u, c, d in zip(upper.tolist(), children[near].tolist(), distances.tolist()):
                    heapq.heappush(queue, (-u, c, d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


class Cells:
    """The cells of one vector length: pivots, and how far a cell's vectors are from its pivot, in both metrics."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots, self.longest = pivots.astype(np.float64), longest
        self.lift = np.sqrt(np.maximum(longest**2 - (self.pivots**2).sum(1), 0))
        self.radii, self.reaches = (np.full(len(pivots), -np.inf) for _ in range(2))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance to the pivot with and without the component that makes lengths equal."""
        lift = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))
        cell = (vectors @ self.pivots.T + lift[:, None] * self.lift[None, :]).argmax(1)
        reach = np.linalg.norm(vectors - self.pivots[cell], axis=1)
        return cell, np.hypot(reach, lift - self.lift[cell]), reach

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and cell a score that nothing in the cell exceeds; minus infinity for a cell without vectors."""
        own = (queries**2).sum(1)[:, None]
        square = own + self.longest**2
        inner = queries @ self.pivots.T
        low = np.maximum(np.sqrt(np.maximum(square - 2 * inner, 0)) - self.radii, 0)
        upper = np.minimum((square - low * low) / 2, inner + np.sqrt(own) * self.reaches) + 2e-7 * square + 0.5
        return np.where(np.isneginf(self.radii), -np.inf, upper)


def _in_chunks(pdf: pd.DataFrame, values: int = 1 << 22) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Vector length, rows and matrix of the rows of one length, at most `values` components or distances to pivots at once."""
    for dim, rows in pdf.groupby("dim", sort=False):
        step = max(1, values // max(int(dim), PIVOTS))
        for at in range(0, len(rows), step):
            part = rows.iloc[at : at + step]
            yield int(dim), part, np.stack(part.vector.to_numpy()).astype(np.float64)


def _assign(cells) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds cell, both distances to its pivot, and a number that parts rows alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seat = 0
        for pdf in batches:
            for dim, rows, vectors in _in_chunks(pdf):
                own = cells.value.get(dim)
                cell, away, reach = own.nearest(vectors) if own else (0, 0.0, 0.0)
                yield rows.assign(cell=cell, away=away, reach=reach, seat=np.arange(seat, seat + len(rows)))
                seat += len(rows)

    return run


def _route(cells, first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the cell that promises a query most, and which cells to search: that one first, then all that may hold a score of `least`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, rows, vectors in _in_chunks(pdf):
                if own := cells.value.get(dim):
                    bounds = own.bounds(vectors)
                    home = bounds.argmax(1)
                    least = rows.least.to_numpy()
                    to = [[h] if first else np.flatnonzero(~np.isneginf(b) & ((b >= l) | (l == NONE))) for b, h, l in zip(bounds, home, least)]
                else:
                    home, to = np.zeros(len(rows), np.int64), [[0]] * len(rows)
                yield rows.assign(home=home, cells=to)

    return run


def _search(k: int):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pages) and len(queries):
            tree = Tree(pages, int(pages.dim.iloc[0]))
            for q in queries.itertuples():
                rows += [(q.query_id, i, s) for s, i in tree.search(q.query_id, np.asarray(q.vector, np.int64), k, int(q.least))]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    pages = pd.DataFrame(build(pdf.vec_id.to_numpy(), np.stack(pdf.vector.to_numpy()).astype(np.int64)))
    pages.insert(0, "page", np.arange(len(pages), dtype=np.int32))
    for column in ("part", "cell", "dim"):
        pages.insert(0, column, pdf[column].iloc[0])
    return pages


def spread(drawn: np.ndarray, k: int) -> np.ndarray:
    """k of the drawn vectors, each the farthest from those before it; fewer if the rest are copies of these."""
    squares = (drawn**2).sum(1)
    chosen, gap = [0], np.full(len(drawn), np.inf)
    while len(chosen) < k:
        gap = np.minimum(gap, squares - 2 * (drawn @ drawn[chosen[-1]]) + squares[chosen[-1]])
        gap[chosen[-1]] = 0
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return drawn[chosen]


def _cells(rows: DataFrame, sizes: DataFrame) -> dict[int, Cells]:
    """Pivots for the vector lengths that fill several shards: a share of PIVOT_VALUES each, so their size is bounded."""
    total = sizes.select(F.sum(F.col("n") * F.col("dim"))).first()[0] or 1
    share = F.floor(F.lit(PIVOT_VALUES) * F.col("n") / F.lit(total))
    wanted = sizes.select("dim", "n", "longest", F.least(F.ceil(F.col("n") / F.col("per")), share, F.lit(PIVOTS)).alias("pivots")).where("pivots > 1")
    drawn = F.xxhash64("vector")
    # Copies of a vector are drawn together and count once.
    some = rows.join(wanted, "dim").where(F.pmod(drawn, F.col("n")) < DRAWN * F.col("pivots")).select("dim", "longest", "pivots", "vector").distinct()
    order = Window.partitionBy("dim").orderBy(drawn, "vector")
    chosen: dict[int, list] = {}
    for r in some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= DRAWN * F.col("pivots")).toLocalIterator():
        chosen.setdefault((r.dim, r.longest, r.pivots), []).append(np.array(r.vector, np.float64))
    return {dim: Cells(spread(np.stack(found), pivots), float(np.sqrt(longest))) for (dim, longest, pivots), found in chosen.items()}


def _meet(pages: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of what the queries find in the shards that they are sent to; pages go to shards with queries only."""
    place = ["dim", "cell", "part"]
    blocks = cut(routed.groupBy(place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), "blocks")
    paged = pages.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(1), "blocks"))).drop("blocks")
    asked = routed.join(blocks, place).withColumn("block", (F.pmod(F.xxhash64("query_id", "vector"), F.col("blocks")) + 1).cast("int")).drop("blocks")
    found = cut(paged.groupBy(*place, "block").cogroup(asked.groupBy(*place, "block")).applyInPandas(_search(k), "query_id long, vec_id long, score long"), "found")
    drop(blocks)
    return found


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for every row whose id is divisible by `every`, the k best rows of other ids.

    Ties go to the smaller id. Vectors that are null, empty or hold null or non-finite components take no
    part, nor do null ids; a query meets vectors of its own length only. Rows that repeat an id are candidates
    each; as queries they share one answer, the best of what their vectors find. Vectors may be of any length; other columns
    don't matter; an empty table gives an empty one. Only pivots and their radii are collected (PIVOT_VALUES).
    """
    spark = vectors.sparkSession
    usable_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    rows = cut(usable_rows.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("vector"), F.size("x").alias("dim")), "vectors")
    per = F.least(F.lit(SHARD), F.greatest(F.lit(1), F.floor(F.lit(SHARD_VALUES) / F.col("dim")))).cast("int").alias("per")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = cut(rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("longest")).withColumn("per", per), "sizes")
    cells = _cells(rows, sizes)
    shared = spark.sparkContext.broadcast(cells)
    placed = cut(rows.mapInPandas(_assign(shared), "vec_id long, vector array<long>, dim int, cell int, away double, reach double, seat long"), "placed")
    shards = cut(placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("reach").alias("reach")).join(sizes.select("dim", "per"), "dim").select("dim", "cell", F.ceil(F.col("n") / F.col("per")).cast("int").alias("parts"), "radius", "reach"), "shards")
    if cells:
        for r in shards.where(F.col("dim").isin(list(cells))).toLocalIterator():
            cells[r.dim].radii[r.cell], cells[r.dim].reaches[r.cell] = r.radius, r.reach
    shared = spark.sparkContext.broadcast(cells)

    parts = shards.select("dim", "cell", "parts")
    dealt = placed.select("dim", "cell", "vec_id", "vector", "seat").join(parts, ["dim", "cell"])
    pages = cut(dealt.select("dim", "cell", F.pmod(F.xxhash64("vec_id", "seat"), F.col("parts")).cast("int").alias("part"), "vec_id", "vector").groupBy("dim", "cell", "part").applyInPandas(_build, PAGES), "pages")
    queries = cut(placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", "dim").distinct(), "queries")
    drop(rows, sizes, placed)

    asked = "query_id long, vector array<long>, dim int, least long, home int, cells array<int>"
    seen_part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")

    def routed(given: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        to = cut(given.mapInPandas(_route(shared, first), asked), "routed")
        each = to.select("query_id", "vector", "dim", "least", "home", F.explode("cells").alias("cell")).join(parts, ["dim", "cell"])
        if first:
            return to, each.withColumn("part", seen_part)
        every_part = each.withColumn("seen", seen_part).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return to, every_part.where((F.col("cell") != F.col("home")) | (F.col("part") != F.col("seen")))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    columns = ("dim", "cell", "part", "query_id", "vector", "least")
    table, sent = routed(queries.withColumn("least", F.lit(NONE)), True)
    near = _meet(pages, sent.select(*columns), k)
    drop(table)
    reached = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    table, sent = routed(queries.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(NONE))).select("query_id", "vector", "dim", "least"), False)
    far = _meet(pages, sent.select(*columns), k)
    drop(table, pages, queries, shards)
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
