"""Language-model scores by a weighted backoff automaton over words.

States are the empty history and every word and word pair met in training. A state's arcs are the n-grams seen LEAST times or
more, whatever the size of the corpus; an arc's weight is its discounted relative frequency, plus what the failure arc would give. The
failure arc leads to the state of the shorter history, and its weight is the probability that discounting left over.
So a state's probabilities sum to one. One traversal from left to right scores a text.

The automaton is never in one place. Its n-grams are keys of 64 bits, dealt to partitions by ranges. Texts become batches of
numbered words once; a batch sends each partition the distinct keys that it has there, with their counts in training texts,
sorted, as one row of packed arrays, and gets back the counts over all batches in the same order. Longer n-grams go first: one of the batches
that have an n-gram is told to send what it takes from its history along with the history's own counts. So every batch ends
up with the part of the automaton that its texts can reach, and a key that all texts have costs one entry a batch.
Two keys that are equal by chance would be taken for one n-gram: about one pair in 4e9 different n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, drop, lower_words, map_texts

#: Words of the longest n-grams; their least count; what is taken from each count.
ORDER, LEAST, DISCOUNT = 3, 2, 0.75
#: What the base model adds to every count.
ADDED = 0.1
#: The token that ends a text; no word is empty.
END = b""
#: Tokens in a batch, about, and in a partition of the automaton; partitions at least.
BATCH, PART, LEAST_PARTS = 750_000, 1_000_000, 16
#: The key of a text's start, and a factor that spreads keys.
START, SPREAD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)

TOKENS = "batch long, n_tokens long, doc_id array<long>, sizes array<int>, train array<boolean>, words binary, vocabulary binary"
SENT = "part int, batch long, keys binary, n binary, taken binary"
REPLY = "level int, part int, batch long, n binary, taken binary, tokens long, types long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def tokens(text: str | None) -> list[bytes]:
    """A text's words and its end."""
    return [*lower_words(text), END]


def packed(x: np.ndarray) -> bytes:
    """The array, compressed with all first bytes first, so that equal high bytes take no room; its size comes before."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return x.nbytes.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where an array's values differ from the one before; the first does."""
    return np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams, from those of their histories and last words."""
    return (history ^ (history >> np.uint64(29))) * SPREAD + word


def numbered(docs: DataFrame) -> DataFrame:
    """Batches of whole texts of `docs` (doc_id, text, train): each word by its number in the batch's vocabulary of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        ids, sizes, train, words, waiting = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            columns = [[(task << 32) + made], [waiting], [ids], [sizes], [train], [packed(np.concatenate(words))], [packed(keys)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

        SCHEMA = pa.schema([("batch", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("train", pa.list_(pa.bool_())), ("words", pa.binary()), ("vocabulary", pa.binary())])
        for b in batches:
            for doc_id, text, trains in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                found = tokens(text.as_py())
                words.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
                ids.append(doc_id)
                sizes.append(len(found))
                train.append(trains)
                waiting += len(found)
                if waiting >= BATCH:
                    yield out()
                    made, number = made + 1, {}
                    ids, sizes, train, words, waiting = [], [], [], [], 0
        if ids:
            yield out()

    return map_texts(docs, run, TOKENS)


@dataclass
class Grams:
    """The distinct n-grams of a level in a batch: keys, counts in training texts, a position of each; of every position, which it is (-1: none)."""

    keys: np.ndarray
    n: np.ndarray
    at: np.ndarray
    which: np.ndarray


class Batch:
    """A batch's positions: every text's start and then its tokens."""

    def __init__(self, row: dict):
        sizes = np.array(row["sizes"], np.int64)
        words, vocabulary = unpacked(row["words"], np.uint32), unpacked(row["vocabulary"], np.uint64)
        self.doc_id, self.sizes = row["doc_id"], sizes
        self.first = np.cumsum(sizes + 1) - sizes - 1
        #: How far a position is from its text's start.
        self.offset = np.arange(len(words) + len(sizes)) - np.repeat(self.first, sizes + 1)
        self.train = np.repeat(np.array(row["train"], bool), sizes + 1)
        #: Numbers of the words; the start has the number after the last.
        self.word = np.full(len(self.offset), len(vocabulary), np.int32)
        self.word[self.offset > 0] = words
        self.vocabulary = np.append(vocabulary, START)

    @cached_property
    def keys(self) -> list[np.ndarray]:
        """Of every level: the key of the n-gram that ends at each position, where there is one."""
        out = [self.vocabulary[self.word]]
        for _ in range(ORDER - 1):
            out.append(longer(np.roll(out[-1], 1), out[0]))
        return out

    def grams(self, level: int) -> Grams:
        """The n-grams of `level` words; a text's start counts as a word, and is before all others."""
        there = np.flatnonzero(self.offset >= level - 1)
        keys = self.keys[level - 1][there]
        order = np.argsort(keys)
        keys = keys[order]
        new = _changes(keys)
        starts = np.flatnonzero(new)
        which = np.full(len(self.offset), -1, np.int32)
        which[there[order]] = np.cumsum(new) - 1
        n = np.add.reduceat(self.train[there[order]].astype(np.int64), starts)
        return Grams(keys[starts], n, there[order[starts]], which)


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partitions are ranges of keys, so ascending keys have ascending partitions."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _send(number: int, grams: Grams, taken: np.ndarray, parts: int) -> pa.Table:
    """One row of SENT for each partition that has some of the batch's keys. taken: what longer n-grams take from each."""
    part = _parts_of(grams.keys, parts)
    cuts = np.flatnonzero(_changes(part))
    rows = [(int(part[i]), number, packed_keys(grams.keys[i:j]), packed(grams.n[i:j].astype(np.uint32)), packed(taken[i:j])) for i, j in zip(cuts, [*cuts[1:], len(part)])]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["part", "batch", "keys", "n", "taken"])


def _sum_up(level: int) -> Callable[[pa.Table], pa.Table]:
    """Answers what batches sent to a partition: sums by key. The lowest bit of a count tells one of them to go on with its history."""

    def run(sent: pa.Table) -> pa.Table:
        batches = sent.column("batch").to_pylist()
        keys = [unpacked_keys(k.as_py()) for k in sent.column("keys")]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        n = np.concatenate([unpacked(x.as_py(), np.uint32) for x in sent.column("n")]).astype(np.uint64)
        taken = np.concatenate([unpacked(x.as_py(), np.float64) for x in sent.column("taken")])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = _changes(keys)
        starts = np.flatnonzero(new)
        sums, all_taken, which = np.add.reduceat(n[order], starts), np.add.reduceat(taken[order], starts), np.cumsum(new) - 1
        reply, back = np.empty(len(order), np.uint64), np.empty(len(order))
        reply[order], back[order] = sums[which] * np.uint64(2) + (new & (sums[which] >= LEAST)), all_taken[which]
        word = (sums > 0) & (keys[starts] != START) if level == 1 else np.zeros(len(sums), bool)
        totals = [(int(sums[word].sum()), int(word.sum())), *[(0, 0)] * (len(batches) - 1)]
        rows = [(level, sent.column("part")[0].as_py(), batch, packed(reply[i:j]), packed(back[i:j]), *total) for batch, i, j, total in zip(batches, [0, *ends[:-1]], ends, totals)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["level", "part", "batch", "n", "taken", "tokens", "types"])

    return run


def _answers(replies: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's n-grams of a level, in the order of their keys: counts, whether it goes on with their histories, what is taken from them."""
    rows = replies.filter(pc.equal(replies.column("level"), level)).select(["part", "n", "taken"]).sort_by("part").to_pylist()
    n = np.concatenate([unpacked(r["n"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
    taken = np.concatenate([unpacked(r["taken"], np.float64) for r in rows]) if rows else np.zeros(0)
    return (n >> np.uint64(1)).astype(np.float64), (n & np.uint64(1)).astype(bool), taken


def _ask(level: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a batch sends for n-grams of `level` words once it knows the counts of those a word longer."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(rows.to_pylist()[0])
        grams, taken = batch.grams(level), np.zeros(0)
        if level < ORDER:
            above = batch.grams(level + 1)
            n, mine, _ = _answers(replies, level + 1)
            history = grams.which[above.at[mine] - 1]
            taken = np.bincount(history, n[mine] - DISCOUNT, len(grams.keys))
        return _send(rows.column("batch")[0].as_py(), grams, taken if len(taken) else np.zeros(len(grams.keys)), parts)

    return run


def _each(ask: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`ask` for batches that need no replies yet."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for i in range(some.num_rows):
                yield from ask(pa.Table.from_batches([some.slice(i, 1)]), None).to_batches()

    return run


def _traverse(n_tokens: int, n_types: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores a batch's texts with its part of the automaton."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        batch = Batch(rows.to_pylist()[0])
        count, _, taken = _answers(replies, 1)
        words = batch.grams(1)
        n = count[words.which]
        p = (n + ADDED) / (n_tokens + ADDED * (n_types + 1))
        token = batch.offset > 0
        base, known = np.where(token, np.log10(p), 0), token & (n > 0)
        state = words.which  # of every position, the state after it
        for level in range(2, ORDER + 1):
            grams = batch.grams(level)
            above, _, above_taken = _answers(replies, level)
            before = np.roll(state, 1)
            total = np.where(before >= 0, count[before], 0)
            there = np.flatnonzero((grams.which >= 0) & (total > 0))  # elsewhere the history is no state
            before, total, mine = before[there], total[there], above[grams.which[there]]
            p[there] = np.where(mine >= LEAST, mine - DISCOUNT, 0) / total + (1 - taken[before] / total) * p[there]
            count, taken, state = above, above_taken, grams.which
            del grams
        sums = [np.add.reduceat(x, batch.first) for x in (known.astype(np.int64), base, np.where(token, np.log10(p), 0))]
        return pa.table([pa.array(batch.doc_id, pa.int64()), pa.array(batch.sizes), *map(pa.array, sums)], [f.split()[0] for f in SCORES.split(", ")])

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row, by the model of the rows where `train` is true.

    Null and empty texts have the end as their only token. Rows that repeat are scored alike, and count in training each. Very long texts
    are a batch of their own. Null ids stay null. Where `train` is null, a row isn't trained on. Other columns don't matter. Without
    training texts, all is unseen. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    batches = cut(numbered(texts), "tokens")
    n = batches.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-n // PART))
    by_batch = batches.groupBy("batch")
    replies: list[DataFrame] = []
    for level in range(ORDER, 0, -1):
        ask = _ask(level, parts)
        sent = by_batch.cogroup(replies[-1].groupBy("batch")).applyInArrow(ask, SENT) if replies else batches.mapInArrow(_each(ask), SENT)
        replies.append(cut(sent.groupBy("part").applyInArrow(_sum_up(level), REPLY), "replies"))
    total = replies[-1].agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    answers = replies[0]
    for more in replies[1:]:
        answers = answers.unionByName(more)
    scores = cut(by_batch.cogroup(answers.groupBy("batch")).applyInArrow(_traverse(total.tokens, total.types), SCORES), "scores")
    drop(batches, *replies)
    return scores.withColumn("train_tokens", F.lit(total.tokens).cast("long"))
