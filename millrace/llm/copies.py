"""Near-duplicates by SimHash, held to an exact similarity of word shingles.

This is the near-duplicate operator where copies are defined by similarity, not by differing bits: pairs that pigeonring
filtering finds on the texts' fingerprints are candidates, and each candidate link is checked on the whole shingle sets. Fingerprints within four
bits don't reach down to a similarity of 0.8, so texts that share the key of a MinHash band are candidates as well: BANDS bands of ROWS
values miss a pair of similarity 0.8 with a chance of 7e-5.

Texts with the same set of shingles are compared once. A bucket is not compared in all pairs: each member is checked against one head,
and then only members that are still in different components are: in small buckets as pairs, in large ones block by block, where a task
gives links that span what it connects and no pairs. So a large group of copies costs about its size in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import cut, drop, map_texts
from millrace.llm.graph import components

SHINGLE, BANDS, ROWS, SEED = 5, 24, 5, 42
#: Copies have this similarity or more, as a fraction.
LEAST = (4, 5)
#: Pairs, about, that one task checks against one text.
CHECKS = 256
#: Buckets of more members than this are compared in blocks of SIDE members.
SMALL, SIDE = 32, 256
_FACTORS, _ADDED = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of SHINGLE words, or of all its words if it has fewer; none without words."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def bands(found: np.ndarray) -> list[int]:
    """Keys under which a set of shingles meets its candidates; an empty set meets none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):  # bounds the table of a very long text
        least = np.minimum(least, (found[at : at + 4096, None] * _FACTORS + _ADDED).min(0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _signed(docs: DataFrame, key: str) -> DataFrame:
    """(key, text, set_id, fp, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            ids = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            prints = [simhash.simhash(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "text", "set_id", "fp", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs.select(F.col(key).alias("key"), "text"), run, f"key {kind}, text string, set_id long, fp long, bands array<long>")


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose sets are similar. A text that is in very many pairs as a is dealt out, CHECKS pairs to a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for b in batches:
            ok = []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if a != last:
                    last, own = a, shingles(x.as_py())
                ok.append(similar(own, shingles(y.as_py())))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    loads = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECKS).cast("int").alias("parts")), "loads")
    first = loads.join(texts.hint("merge"), F.col("a") == F.col("set_id")).select("a", F.explode(F.sequence(F.lit(1), "parts")).alias("part"), F.col("text").alias("text_a"))
    second = pairs.join(texts.hint("merge"), F.col("b") == F.col("set_id")).select("a", "b", F.col("text").alias("text_b"))
    dealt = second.join(loads.hint("merge"), "a").select("a", "b", "text_b", (F.pmod(F.xxhash64("b"), F.col("parts")) + 1).cast("int").alias("part"))
    links = cut(map_texts(dealt.join(first.hint("merge"), ["a", "part"]).select("a", "b", "text_a", "text_b"), run, "a long, b long"), "links")
    drop(loads)
    return links


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between members outside the bucket's largest component and all members, for one pair of blocks; none within a component.

    A pair that shares several bands is compared in the first of them only.
    """
    outside = pdf[pdf.outside].reset_index(drop=True)
    members = pdf[~pdf.outside].reset_index(drop=True)
    links: list[tuple[int, int]] = []
    if len(outside) and len(members):
        sets = {i: shingles(t) for i, t in {**dict(zip(outside.set_id, outside.text)), **dict(zip(members.set_id, members.text))}.items()}
        above: dict[int, int] = {}

        def top(root: int) -> int:
            while root in above:
                root = above[root]
            return root

        x_bands, y_bands = np.stack(outside.bands.to_numpy()), np.stack(members.bands.to_numpy())
        y_ids, y_roots, y_main = members.set_id.to_numpy(), members.root.to_numpy(), (members.root == members.main).to_numpy()
        y_sizes = np.array([len(sets[i]) for i in y_ids])
        for x, root, own in zip(outside.set_id, outside.root, x_bands):
            equal = own[None, :] == y_bands
            here = y_bands[np.arange(len(y_bands)), equal.argmax(1)] == pdf.key.iloc[0]
            n = len(sets[x])
            may = here & (y_roots != root) & (y_main | (y_ids > x)) & (LEAST[1] * np.minimum(n, y_sizes) >= LEAST[0] * np.maximum(n, y_sizes))
            for k in np.flatnonzero(may):
                a, b = top(root), top(y_roots[k])
                if a != b and similar(sets[x], sets[y_ids[k]]):
                    above[a] = b
                    links.append((x, y_ids[k]))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b) candidates: sets with equal fingerprints, and the heads of those that pigeonring filtering links."""
    heads = cut(sets.groupBy("fp").agg(F.min("set_id").alias("head"), F.count("*").alias("n")), "heads")
    equal = sets.join(heads.where("n > 1").hint("merge"), "fp").where("set_id <> head").select(*_pairs("set_id", "head"))
    links = cut(simhash.near_links(heads.select("fp")), "fingerprint-links")
    near = links.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")).hint("merge"), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")).hint("merge"), "b")
    out = cut(equal.unionByName(near.where("x <> y").select(*_pairs("x", "y"))), "fingerprint-pairs")
    drop(heads, links)
    return out


def near_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, set_id, root) of every row: rows linked by copies have one root; key is the column of that name, of any type.

    Texts without words, null or empty, are one group. Repeated rows and rows of equal texts share a root. Texts of fewer than SHINGLE words
    are one shingle, so only equal ones are copies. Which set is a head changes no result. An empty table gives an empty one.
    """
    signed = cut(_signed(docs, key), "signed")
    sets = cut(signed.groupBy("set_id").agg(F.min("fp").alias("fp"), F.min(F.struct("text")).alias("t"), F.first("bands").alias("bands")).select("set_id", "fp", "t.text", "bands"), "sets")
    texts = sets.select("set_id", "text")
    filed = sets.select("set_id", F.explode("bands").alias("key"))
    sizes = cut(filed.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("head")).where("n > 1"), "buckets")
    filed = cut(filed.join(sizes.hint("merge"), "key"), "filed")
    by_print = _by_fingerprint(sets.select("set_id", "fp"))
    first = cut(filed.where("set_id <> head").select(*_pairs("set_id", "head")).unionByName(by_print).distinct(), "first-pairs")
    links = _checked(first, texts)

    # What shares a bucket and is not linked yet: all members against those outside the bucket's largest component.
    roots = cut(components(links), "first-roots")
    placed = filed.where("n > 2").join(roots.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
    placed = cut(placed, "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = cut(parts.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1"), "mixed")
    within = cut(placed.join(mixed.hint("merge"), "key"), "within")
    small = within.where(F.col("n") <= SMALL)
    apart = small.where("root <> main").select("key", F.col("set_id").alias("x"), F.col("root").alias("x_root"))
    second = apart.join(small.select("key", "set_id", "root").hint("merge"), "key").where("root <> x_root").select(*_pairs("x", "set_id")).distinct()
    second = cut(second.join(first.hint("merge"), ["a", "b"], "left_anti"), "second-pairs")
    more = _checked(second, texts)

    large = within.where(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / SIDE).cast("int")).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = large.where("root <> main").select("key", F.col("block").alias("i"), every.alias("j"), "set_id", "root", "main", F.lit(True).alias("outside")).unionByName(
        large.select("key", every.alias("i"), F.col("block").alias("j"), "set_id", "root", "main", F.lit(False).alias("outside")))
    sides = sides.join(sets.drop("fp").hint("merge"), "set_id")
    blocks = cut(sides.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long"), "block-links")
    roots = cut(components(links.unionByName(more).unionByName(blocks)), "roots").withColumnRenamed("node", "set_id").hint("merge")
    out = cut(signed.select("key", "set_id").join(roots, "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root")), "copies")
    drop(signed, sets, sizes, filed, by_print, first, placed, mixed, within, second, links, more, blocks)
    return out
