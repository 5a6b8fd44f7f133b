"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors of one label are dealt into tiles. For each pair of tiles, unit vectors are quantised to int8 with a scale
each; the product of the quantised tiles gives every cosine to within a bound that follows from the two
vectors' own quantisation errors. Only pairs whose upper bound reaches the threshold are computed again, in double precision.
A pair of tiles gives counts of links and at most one spanning link per vector, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.llm.graph import components

#: Vectors in a tile, and rows of a tile that are multiplied at a time.
TILE, STRIPE = 2048, 256


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(~bad, F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of what the codes leave of each unit vector."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Yields (rows of a, rows of b) of the pairs with cosine >= threshold, stripe by stripe; each pair once if `same`.

    With x = s q + e for both vectors of a pair, x.y differs from s s' q.q' by at most |e||y| + |e'||x| + |e||e'|, and
    |x| = |y| = 1 up to rounding, for which the bound has room.
    """
    # Scaled by the largest component first, so that no square overflows or vanishes.
    lengths = [(s := np.abs(x).max(1), np.linalg.norm(x / s[:, None], axis=1)) for x in (a, b)]
    ua, ub = (x / s[:, None] / n[:, None] for x, (s, n) in zip((a, b), lengths))
    (qa, sa, ea), (qb, sb, eb) = quantise(ua), quantise(ub)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are exact in it
    qa, qb = qa.astype(exact), qb.astype(exact)
    for at in range(0, len(a), STRIPE):
        rows = slice(at, at + STRIPE)
        upper = (qa[rows] @ qb.T).astype(np.float64)
        upper *= sa[rows, None] * sb[None, :]
        upper += ea[rows, None] * (1 + eb[None, :]) + eb[None, :] + 1e-9
        i, j = np.nonzero(upper >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            linked = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            if linked.any():
                yield x[linked], y[linked]


def _tile_pair(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.side.to_numpy() != 1  # 0: tile i, 1: tile j, 2: both
        second = pdf.side.to_numpy() != 0
        same = bool((pdf.side == 2).all())
        a, b = pdf[first], pdf[second]
        out = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if not len(a) or not len(b):
            return out
        xa = np.stack(a.embedding.to_numpy()).astype(np.float64)
        xb = xa if same else np.stack(b.embedding.to_numpy()).astype(np.float64)
        node = np.concatenate((a.node.to_numpy(), b.node.to_numpy()))
        n, weight = len(a), [x.copies.to_numpy() for x in (a, b)]
        count, label = [np.zeros(len(x), np.int64) for x in (a, b)], node.copy()
        links: list[tuple[int, int]] = []
        for i, j in tile_links(xa, xb, threshold, same):
            count[0] += np.bincount(i, weight[1][j], len(a)).astype(np.int64)
            count[1] += np.bincount(j, weight[0][i], len(b)).astype(np.int64)
            # Links that connect what this stripe connects: to the least label, until nothing changes.
            while True:
                low = np.minimum(label[i], label[n + j])
                before = label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, n + j, low)
                moved = np.flatnonzero(label != before)
                links += zip(before[moved].tolist(), label[moved].tolist())
                if not len(moved):
                    break
        rows = {(x, y) for x, y in links if x != y}
        made = pd.DataFrame(list(rows), columns=["a", "b"]).assign(links=0)
        tallies = [pd.DataFrame({"a": x.node.to_numpy(), "b": x.node.to_numpy(), "links": c})[c > 0] for x, c in ((a, count[0]), (b, count[1]))]
        return pd.concat([made, *tallies]).astype("int64")

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows of equal, non-null labels are linked if their cosine is at least `threshold`. Equal vectors are compared once,
    whatever their number, and count as that many links. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do vectors of different lengths; a row without links is its own component.
    Rows that share an id are one node of the link graph: they have one component, also those whose vectors take no part, while n_links counts what the row's
    own vector is linked with. Null ids link with nothing. Other columns don't matter. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    # Adding zero makes -0 equal to 0, for the hash as well.
    rows = rows.withColumn("embedding", F.when(fit, F.transform("embedding", lambda x: x + F.lit(0.0)))).withColumn("hash", F.xxhash64("label", "embedding"))
    groups = rows.where(F.col("embedding").isNotNull()).groupBy("hash", "label", "embedding").agg(F.count("*").alias("copies"))
    groups = cut(groups.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    # The hash only deals rows out; label and vector decide.
    named = groups.select("hash", "label", "embedding", "node")
    ids = cut(rows.where(F.col("embedding").isNotNull()).join(named.hint("merge"), ["hash", "label", "embedding"]).select("vec_id", "node"), "ids")
    idle = rows.where(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"))

    tiles = cut(groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "tiles")
    tiled = groups.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.col("hash"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = tiled.select("label", "dim", "tile", "node", "copies", "embedding", other)
    pairs = pairs.select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "copies", "embedding",
                         F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).alias("side"))
    found = cut(pairs.groupBy("label", "dim", "i", "j").applyInPandas(_tile_pair(threshold), "a long, b long, links long"), "tile-links")

    # Vectors that share an id are linked through it.
    of_id = ids.distinct()
    shared = of_id.groupBy("vec_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("vec_id", "a")
    links = found.where("a <> b").select("a", "b").unionByName(of_id.join(shared.hint("merge"), "vec_id").select("a", F.col("node").alias("b")))
    roots = cut(components(links), "roots")
    rooted = cut(of_id.join(roots.hint("merge"), "node", "left").select("vec_id", F.coalesce("root", "node").alias("root")).distinct(), "rooted")
    names = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    by_id = rooted.join(cut(names, "names").hint("merge"), "root").select("vec_id", "component_id").distinct()
    tallies = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    counts = groups.select("node", "copies").join(tallies, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    counted = ids.join(cut(counts, "counts").hint("merge"), "node").select("vec_id", F.col("n_links").cast("long").alias("n_links"))
    out = counted.unionByName(idle).join(cut(by_id, "by-id").hint("merge"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
