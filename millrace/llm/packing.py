"""Packing of token sequences by cutting-stock column generation.

Texts are tokenized once. Each document is cut into pieces of the full sequence length and one remainder.
Remainders are counted in a histogram of length classes. A linear program over patterns (how many pieces of
each class share a sequence) is solved by column generation: a knapsack by dynamic programming prices new
patterns with the program's duals. The rounded pattern counts say which pieces share a sequence: the pieces
of a class are ranked, and ranks are dealt to the patterns' slots. Only the histogram goes to the driver;
its size depends on the sequence length alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, map_texts

#: Tokens in a length class; a class's pieces are planned as long as its longest.
GRAIN = 16
#: The program is solved to this share above the least that could do.
GAP = 0.0005
#: Pieces, about, in one bin of a class; a bin is ranked by one task.
RANK_ROWS = 500

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Encodings that this Python process has read.
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The byte-level encoding that a tokenizer's JSON file describes: its merges and the tokens added to them.

    Text is parted by `pattern`, the added tokens by their own strings. Each Python process reads the file once.
    """
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary = made["model"]["vocab"]
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in made["model"]["merges"]]
        if merged != sorted(merged) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{path}: ids have to follow the merges, and added tokens to stand for their own strings only")
        added = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODINGS[path, pattern]


def encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text, as the tokenizer of the JSON file gives them by itself: added tokens are found in the text, none are put around it."""
    made = encoding(path, pattern)
    added = made.special_tokens_set

    def encode(text: str) -> np.ndarray:
        return made.encode_to_numpy(text, allowed_special=added if any(t in text for t in added) else set(), disallowed_special=())

    return encode


def pieces(docs: DataFrame, tokenizer: tuple[str, str], capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of every document: full ones and a remainder, with the checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*tokenizer)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest value: counts of each size (in grains) whose sum is at most `capacity`."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fits:
            gain = best[room - sizes[:fits]] + value[:fits]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], chosen[room] = gain[k], k
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover the demand of each size exactly, with close to the fewest sequences.

    Column generation with a revised simplex: the basis starts with the patterns of one size each. A round
    prices one pattern; GAP or the round limit ends it, with a feasible basis in either case. The solution is rounded down; what it leaves is packed by first fit decreasing, which is a small number of pieces
    (each of at most len(sizes) basic patterns leaves less than one sequence).
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / basis.diagonal()), demand / basis.diagonal()
    bound = float(sizes @ demand) / capacity
    for _ in range(rounds):
        value, pattern = _knapsack(np.maximum(inverse.sum(0), 0), sizes, capacity)
        if value <= 1 + 1e-7 or x.sum() <= bound * (1 + GAP):
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        moved = ratio[out]
        x = np.maximum(x - moved * step, 0)
        x[out] = moved
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        basis[:, out] = pattern
    left, plan = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x):
        pattern = basis[:, k].astype(np.int64)
        uses = pattern > 0
        times = min(int(x[k] + 1e-6), int((left[uses] // pattern[uses]).min()))
        if times:
            plan.append((pattern, times))
            left -= times * pattern
    rooms: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-sizes):
        while left[k]:
            for i, (room, pattern) in enumerate(rooms):
                if room >= sizes[k]:
                    fit = min(int(left[k]), int(room // sizes[k]))
                    pattern[k] += fit
                    left[k] -= fit
                    rooms[i] = (room - fit * sizes[k], pattern)
                    if not left[k]:
                        break
            if left[k]:
                fit = min(int(left[k]), int(capacity // sizes[k]))
                pattern = np.zeros(m, np.int64)
                pattern[k] = fit
                left[k] -= fit
                rooms.append((int(capacity - fit * sizes[k]), pattern))
    return plan + [(pattern, 1) for _, pattern in rooms]


def slots(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """The ranks of each class that each pattern takes: from `first` on, `each` in every sequence from number `base` on."""
    rows, taken, base = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in plan:
        for k in np.flatnonzero(pattern):
            rows.append((int(sizes[k]), int(taken[k]), int(pattern[k]), base))
            taken[k] += pattern[k] * times
        base += times
    return pd.DataFrame(rows, columns=["cls", "first", "each", "base"]).sort_values(["cls", "first"])


def pack(docs: DataFrame, tokenizer: tuple[str, str], capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a byte-level tokenizer's JSON file, which every executor can open, and the pattern that parts its text.
    Null texts are empty: their only id is the end. Rows that repeat an id or a text are packed like any other. Other columns don't matter.
    A sequence is filled from 0 without gaps; what it lacks to `capacity` (or to a power of two that it
    reaches) is padding. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, tokenizer, capacity, end_id).withColumn("cls", F.ceil(F.col("length") / GRAIN).cast("int")), "pieces")
    # Ranks within a class: dealt to bins by hash, ranked within a bin, moved by the sizes of the bins before.
    bins = cut_up.groupBy("cls").agg(F.count("*").alias("n"))
    histogram = {r.cls: r.n for r in bins.collect()}  # at most capacity / GRAIN rows
    n_bins = F.create_map(*(F.lit(x) for k, n in histogram.items() for x in (k, -(-n // RANK_ROWS)))) if histogram else F.lit(None).cast("map<int,int>")
    binned = cut_up.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(n_bins, F.col("cls"))))
    by_bin = binned.groupBy("cls", "bin").agg(F.count("*").alias("n"))
    before = by_bin.select("cls", "bin", (F.sum("n").over(Window.partitionBy("cls").orderBy("bin")) - F.col("n")).alias("before"))
    in_bin = F.row_number().over(Window.partitionBy("cls", "bin").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")) - 1  # rows equal in all these are alike
    ranked = binned.withColumn("in_bin", in_bin).join(before, ["cls", "bin"]).withColumn("rank", F.col("before") + F.col("in_bin"))

    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in sizes.tolist()], np.int64)
    plan = slots(sizes, solve_patterns(sizes, demand, -(-capacity // GRAIN)))
    by_class = {k: g for k, g in plan.groupby("cls")}

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence = np.zeros(len(pdf), np.int64)
            for k, at in pdf.groupby("cls").indices.items():
                g, rank = by_class[k], pdf["rank"].to_numpy()[at]
                i = np.searchsorted(g["first"].to_numpy(), rank, "right") - 1
                sequence[at] = g["base"].to_numpy()[i] + (rank - g["first"].to_numpy()[i]) // g["each"].to_numpy()[i]
            yield pdf.drop(columns=["rank", "cls"]).assign(sequence_id=sequence)

    seated = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "cls").mapInPandas(
        seat, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    so_far = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, 0))
    return seated.withColumn("offset", so_far - F.col("length"))
