"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonring filtering.

A fingerprint is cut into `SEGMENTS` consecutive segments on a ring. If two fingerprints differ in at
most `max_bits` bits, some segment starts a chain whose first l segments differ in at most
floor(l * max_bits / SEGMENTS) bits together, for every l. With 5 segments and 4 bits: the first segment is equal,
the first two differ in one bit at most, the first three in two, the first four in three. The first two conditions are
met by an equi-join on 25 to 26 bits: each fingerprint is filed under its own two segments and looked up under
these and all values that differ from them in one bit of the second. From `LONG_CHAINS` fingerprints on the third condition
joins as well, on 38 to 39 bits: more look-ups, each of which meets far fewer others. The other conditions
prune the candidates before the Hamming distance of the whole is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, lower_words, map_texts
from millrace.llm.graph import components

SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: The distance that SEGMENTS and the join's key are made for.
MAX_BITS = 4
#: Segments in a key, and the number of fingerprints from which there is one more. A fingerprint has 70 look-ups under two segments and 1370 under
#: three; under two each meets one other for 2^26 fingerprints, so both cost the same at about 1300 / 70 * 2^26.
CHAIN, LONG_CHAINS = 2, 1_200_000_000
#: A key under which more fingerprints than this are filed is compared in blocks of this many.
BLOCK = 512


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, or of all its words if it has fewer; none without words."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    first = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(first, last)], "<u8")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit integer; 0 without words."""
    return simhash(shingle_hashes(text, shingle))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):  # bounds the bit matrix of a very long text
        set_in += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _mask(start: int, chain: int) -> int:
    """The bits of `chain` segments from number `start` on, around the ring, as a signed integer."""
    bits = sum(((1 << w) - 1) << at for at, w in (SEGMENTS[(start + k) % len(SEGMENTS)] for k in range(chain)))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _within(start: Column, diff: Column, keyed: int) -> Column:
    """The chain conditions that a key of `keyed` segments doesn't meet by itself, then the full check."""
    ok = F.lit(True)
    for chain in range(keyed + 1, len(SEGMENTS)):
        mask = F.element_at(F.array(*(F.lit(_mask(i, chain)) for i in range(len(SEGMENTS)))), start.cast("int") + 1)
        ok = ok & (F.bit_count(diff.bitwiseAND(mask)) <= chain * MAX_BITS // len(SEGMENTS))
    return ok & (F.bit_count(diff) <= MAX_BITS)


def _flips(start: int, chain: int) -> list[int]:
    """What keys of `chain` segments from number `start` on may differ in: in all chains within them, no more bits than these may."""
    found = [(0, 0)]
    for step in range(1, chain):
        width, shift, budget = SEGMENTS[(start + step) % len(SEGMENTS)][1], 13 * (chain - 1 - step), (step + 1) * MAX_BITS // len(SEGMENTS)
        found = [(flip | sum(1 << shift + b for b in bits), n + more) for flip, n in found for more in range(budget - n + 1) for bits in combinations(range(width), more)]
    return [flip for flip, _ in found]


def _keys(fps: DataFrame, chain: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) under which fingerprints are filed, and under which they are looked up; a key is the chain's start and its segments of 13 bits."""
    filed, looked = [], []
    for i in range(len(SEGMENTS)):
        key = F.lit(i).cast("long")
        for at, width in (SEGMENTS[(i + k) % len(SEGMENTS)] for k in range(chain)):
            key = F.shiftleft(key, 13).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)))
        filed.append(key)
        flips = F.array(*(F.lit(flip).cast("long") for flip in _flips(i, chain)))
        looked.append(F.transform(flips, key.bitwiseXOR))
    return fps.select(F.explode(F.array(*filed)).alias("key"), "fp"), fps.select(F.explode(F.concat(*looked)).alias("key"), "fp")


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that span what is linked within one pair of blocks: at most one for each fingerprint."""
    filed, looked = (np.unique(pdf.fp.to_numpy()[pdf.looked.to_numpy() == side]) for side in (False, True))
    near = np.bitwise_count((filed[:, None] ^ looked[None, :]).view(np.uint64)) <= MAX_BITS
    label = filed.copy()
    reach = np.full(len(looked), np.iinfo(np.int64).max)
    while near.any():
        reach = np.where(near, label[:, None], np.iinfo(np.int64).max).min(0)
        now = np.minimum(label, np.where(near, reach[None, :], np.iinfo(np.int64).max).min(1))
        if (now == label).all():
            break
        label = now
    met = near.any(0)
    return pd.DataFrame({"a": np.concatenate((filed, looked[met])), "b": np.concatenate((label, reach[met]))})


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints that connect exactly those within MAX_BITS of each other.

    Keys with up to BLOCK fingerprints give all their pairs by a join. A key with more is dealt out in pairs of blocks,
    each of which gives links that connect the same fingerprints; no task ever holds a whole key.
    """
    chain = CHAIN if fps.count() < LONG_CHAINS else CHAIN + 1
    filed, looked = _keys(fps, chain)
    large = cut(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-keys")
    has_large = large.limit(1).count() > 0
    small = filed.join(large, "key", "left_anti") if has_large else filed
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    pairs = looked.join(small.select("key", F.col("fp").alias("other")).hint("shuffle_hash"), "key")
    links = pairs.where((F.col("fp") < F.col("other")) & _within(F.shiftright("key", 13 * chain), diff, chain)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if has_large:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        sides = filed.join(large, "key").select("key", block.alias("i"), every.alias("j"), "fp", F.lit(False).alias("looked")).unionByName(
            looked.join(large, "key").select("key", every.alias("i"), block.alias("j"), "fp", F.lit(True).alias("looked")))
        links = links.unionByName(sides.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long"))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Documents with equal fingerprints are linked; distinct fingerprints are compared once, whatever the number
    of their documents. Null and empty texts have fingerprint 0 and are linked with each other; null ids
    get the component of their fingerprint and are never its name (null where no other id is in it).
    Rows that share an id but not a fingerprint share no component by that. Whole texts count, however long; other columns
    don't matter. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = components(near_links(groups.select("fp")))
    rooted = cut(groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(cut(names, "names").hint("merge"), "root").select("fp", "component_id"), "named")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")
