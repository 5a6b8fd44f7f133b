"""Ranked lexical search: dual-sorted wavelet trees over shards of documents, searched best-first.

`Index` reads the documents once and writes their postings as shards of at most SHARD_DOCS documents and about SHARD_POSTINGS postings, made where the
documents are read, without a shuffle. A search deals with its items in blocks. For a block, each shard's postings of the terms asked for are put in a row, term
after term, by falling impact, and a wavelet tree over their document numbers (which rise with doc_id) is built on that row. A node of the tree is a range of
documents; each term's postings in it are a range that still falls in impact, so the first one bounds what the term gives to any document of the node.
Nodes are opened in the order of the sum of their terms' bounds until no unopened one reaches the k-th score; at a leaf the bound is the score.

A sixteenth of the shards, taken by a hash, is searched first; the k-th scores found there are floors for the search of all others, so what these
send on doesn't grow with the number of shards. The driver gets the items of one block at a time, with one number for each of their terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, map_texts

SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
#: Items and bytes of their texts in a block (a longer text is a block of its own).
BLOCK_ITEMS, BLOCK_BYTES = 2000, 4 << 20
#: Nodes opened at a time; and the share of shards whose results are floors for the others, one in so many.
OPENED, FLOOR_SHARE = 64, 16
SHARD_SCHEMA = "docs binary, known binary, lengths binary, terms binary, df binary, post_doc binary, post_tf binary, n_docs long, n_terms long"
HITS = "item int, doc_id long, score long"

#: Bytes that are in no term become spaces, A-Z small letters; those beyond ASCII stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8: runs of letters, digits and all that is beyond ASCII, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a partition's documents that have terms: postings by term, then document; documents by doc_id, null last."""
    ids, vocab, docs, tfs, lengths = [], {}, [], [], []

    def shard() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        place = np.empty(len(ids), np.uint16)
        place[order] = np.arange(len(ids))
        names = sorted(vocab)
        rank = np.empty(len(vocab), np.int64)
        rank[[vocab[t] for t in names]] = np.arange(len(names))
        which, count = np.concatenate(docs), np.concatenate(tfs)
        which, doc = rank[which], np.repeat(place, [len(d) for d in docs])
        by = np.lexsort((doc, which))
        row = {
            "docs": np.array([ids[i] or 0 for i in order], np.int64), "known": np.array([ids[i] is not None for i in order], np.uint8), "lengths": np.array([lengths[i] for i in order], np.int64),
            "terms": b" ".join(names), "df": np.bincount(which, minlength=len(names)).astype(np.uint16), "post_doc": doc[by], "post_tf": count[by],
        }
        out = {k: [v if isinstance(v, bytes) else v.tobytes()] for k, v in row.items()} | {"n_docs": [len(ids)], "n_terms": [sum(lengths)]}
        for kept in (ids, vocab, docs, tfs, lengths):
            kept.clear()
        return pa.RecordBatch.from_pydict(out)

    postings = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            own = Counter(terms(text.as_py()))
            if not own:
                continue
            ids.append(doc_id.as_py())
            lengths.append(own.total())
            docs.append(np.fromiter((vocab.setdefault(t, len(vocab)) for t in own), np.uint32, len(own)))
            tfs.append(np.fromiter(own.values(), np.uint32, len(own)))
            postings += len(own)
            if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard()
                postings = 0
    if ids:
        yield shard()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Tree:
    """The dual-sorted wavelet tree of one shard, for the terms asked for.

    `zeros[d]` counts, for each place of depth d, the postings before it that go to the lower half of their node; `impact[d]` has the postings' impacts in
    that depth's order. Depth 0 is the row of postings by term and falling impact; at the last depth each node is one document.
    """

    def __init__(self, row: dict, asked: dict[bytes, int], all_docs: int, all_terms: int):
        self.docs, self.known = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["known"], np.uint8)
        names, df = row["terms"].split(b" "), np.frombuffer(row["df"], np.uint16).astype(np.int64)
        begin = np.cumsum(df) - df
        found = np.array([(i, asked[t]) for i, t in enumerate(names) if t in asked], np.int64).reshape(-1, 2)
        spans = [np.arange(begin[i], begin[i] + df[i]) for i in found[:, 0]]
        take = np.concatenate(spans) if spans else np.empty(0, np.int64)
        term = np.repeat(found[:, 1], df[found[:, 0]])
        doc = np.frombuffer(row["post_doc"], np.uint16)[take].astype(np.int64)
        tf = np.frombuffer(row["post_tf"], np.uint32)[take].astype(np.int64)
        length = np.array([75 + 25 * n * all_docs // all_terms for n in np.frombuffer(row["lengths"], np.int64).tolist()], np.int64)  # Python's integers: the product may pass 64 bits
        gain = 1_000_000_000 * tf // (1000 * tf + 12 * length[doc])
        by = np.lexsort((doc, -gain, term))
        doc, gain, term = doc[by], gain[by], term[by]
        self.first = {int(t): (int(np.searchsorted(term, t)), int(np.searchsorted(term, t, "right"))) for t in found[:, 1]}
        self.depth = max(1, int(len(self.docs) - 1).bit_length())
        self.zeros = np.zeros((self.depth, len(doc) + 1), np.int32)
        self.impact = np.zeros((self.depth + 1, len(doc) + 1), np.int32)
        self.impact[0, :-1] = gain
        for d in range(self.depth):
            low = (doc >> (self.depth - 1 - d)) & 1 == 0
            np.cumsum(low, out=self.zeros[d, 1:])
            by = np.argsort(doc >> (self.depth - 1 - d), kind="stable")
            doc, gain = doc[by], gain[by]
            self.impact[d + 1, :-1] = gain

    def search(self, wanted: list[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, place) of those that reach `floor`; equal scores in the order of places. `wanted` has (term, weight times repeats)."""
        here = [(self.first[t], w) for t, w in wanted if t in self.first and w > 0]
        if not here:
            return []
        weights = np.array([w for _, w in here], np.int64)
        lo, hi = (np.array([[span[i] for span, _ in here]], np.int64) for i in (0, 1))
        bound = int((weights * self.impact[0, lo[0]]).sum())
        size = self.zeros.shape[1] - 1
        waiting = [(-bound, 0, 0, 0, size, lo[0], hi[0])]  # -bound, first place, depth, where the node begins and ends in its depth, its terms' ranges
        best: list[tuple[int, int]] = []  # (score, -place)
        while waiting and -waiting[0][0] >= floor:
            opened = []
            while waiting and len(opened) < OPENED and -waiting[0][0] >= floor:
                opened.append(heapq.heappop(waiting))
            depth = np.array([o[2] for o in opened])
            start, end = (np.array([o[i] for o in opened], np.int64) for i in (3, 4))
            lo, hi = (np.stack([o[i] for o in opened]) for i in (5, 6))
            at = depth[:, None]
            before = self.zeros[depth, start].astype(np.int64)
            lows = self.zeros[depth, end] - before
            lo0, hi0 = self.zeros[at, lo] - before[:, None], self.zeros[at, hi] - before[:, None]
            base = start[:, None]
            for half, (a, b, s, e) in enumerate(((base + lo0, base + hi0, start, start + lows), (base + lows[:, None] + lo - base - lo0, base + lows[:, None] + hi - base - hi0, start + lows, end))):
                bounds = np.where(b > a, self.impact[at + 1, a] * weights, 0).sum(1)
                for i in np.flatnonzero((bounds > 0) & (bounds >= floor)):
                    level = int(depth[i]) + 1
                    place = opened[i][1] + (half << (self.depth - level))
                    if level < self.depth:
                        heapq.heappush(waiting, (-int(bounds[i]), place, level, int(s[i]), int(e[i]), a[i], b[i]))
                        continue
                    heapq.heappush(best, (int(bounds[i]), -place))
                    if len(best) > k:
                        heapq.heappop(best)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
        return sorted(((s, -p) for s, p in best), key=lambda x: (-x[0], x[1]))


class Index:
    """The postings of `docs` (doc_id, text), written once for any number of searches.

    Documents without terms, of null or empty texts, are in no result and not counted. Texts of any length are one document; rows that repeat are documents of
    their own, null ids come after all others. Further columns don't matter. An empty table gives empty results.
    """

    def __init__(self, docs: DataFrame):
        self.shards = cut(map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _shards, SHARD_SCHEMA), "shards")
        totals = self.shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        self.docs, self.terms = totals.docs or 0, totals.terms or 0

    def frequencies(self, asked: set[bytes]) -> dict[bytes, int]:
        """In how many documents each of these terms is."""

        def own(batches):
            for batch in batches:
                for names, df in zip(batch.column("terms"), batch.column("df")):
                    here = [(t, n) for t, n in zip(names.as_py().split(b" "), np.frombuffer(df.as_py(), np.uint16).tolist()) if t in asked]
                    yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in here], pa.binary()), "n": pa.array([n for _, n in here], pa.int64())})

        rows = map_texts(self.shards.select("terms", "df"), own, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        return {bytes(r.term): r.n for r in rows}

    def top_k(self, items: DataFrame, k: int = 20) -> DataFrame:
        """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item (item_id, text), ties to the smaller doc_id.

        Items without terms have no rows. Items that repeat an item_id are ranked each by itself.
        """
        out, block, held = None, [], 0
        for item in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
            own = Counter(terms(item.text))
            if own:
                block.append((item.item_id, own))
                held += len(item.text)
            if len(block) >= BLOCK_ITEMS or held >= BLOCK_BYTES:
                found = self._block(block, k)
                out, block, held = out.unionByName(found) if out is not None else found, [], 0
        if block or out is None:
            found = self._block(block, k)
            out = out.unionByName(found) if out is not None else found
        return out

    def _block(self, block: list[tuple[int | None, Counter]], k: int) -> DataFrame:
        spark, all_docs, all_terms = self.shards.sparkSession, self.docs, self.terms
        asked = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        df = self.frequencies(set(asked)) if block else {}
        wanted = [[(asked[t], n * weight(all_docs, df[t])) for t, n in own.items() if t in df] for _, own in block]

        def searching(floors: list[int]):
            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """The best hits of all shards of a partition: k for each item at most."""
                best: list[list] = [[] for _ in wanted]
                for batch in batches:
                    for row in batch.to_pylist():
                        tree = Tree(row, asked, all_docs, all_terms)
                        for item, own in enumerate(wanted):
                            low = max(floors[item], best[item][k - 1][0] if len(best[item]) >= k else 1)
                            found = [(s, bool(tree.known[p]), int(tree.docs[p])) for s, p in tree.search(own, k, low)]
                            if found:
                                best[item] = sorted(best[item] + found, key=lambda x: (-x[0], not x[1], x[2]))[:k]
                rows = [(item, doc if known else None, s) for item, own in enumerate(best) for s, known, doc in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

            return search

        first = F.pmod(F.xxhash64("docs", "lengths"), F.lit(FLOOR_SHARE)) == 0
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        early = cut(best(map_texts(self.shards.where(first), searching([1] * len(block)), HITS)).drop("rank"), "early")
        floors = [1] * len(block)
        for r in early.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).collect():
            floors[r.item] = r.low
        late = map_texts(self.shards.where(~first), searching(floors), HITS)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
        return best(early.unionByName(late)).join(names, "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT doc_id, ts, len(ts) AS n FROM x WHERE len(ts) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM d) GROUP BY ALL),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * g.nn) // g.ll)))) AS BIGINT) AS score
      FROM p JOIN q ON q.t = p.t JOIN w ON w.t = p.t CROSS JOIN g GROUP BY q.item_id, p.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
