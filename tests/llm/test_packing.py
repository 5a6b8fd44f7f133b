import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = ["a  b", " a b ", "x \n y\n z", "  q", "", "  ", "a\tb c", "hello world 　 ok", "w1 's it's", "<|endoftext|> x", "hello <|endoftext|>x", "<|endoftext|><|endoftext|>", "<|endoftext", "  <|endoftext|>  it's", "é" * 4000, "many words " * 5000, None]


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids_of, capacity=2048):
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(ids_of)
    for doc_id, found in seen.items():
        assert_gapless(found, len(ids_of[doc_id]))
    for found in sequences.values():
        assert_gapless(found, None)
        assert sum(n for _, n in found) <= capacity
    return sum(n for f in sequences.values() for _, n in f) / (capacity * len(sequences))


def assert_gapless(found, total):
    at = 0
    for start, n in sorted(found):
        assert start == at and n > 0
        at += n
    assert total is None or at == total


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(ODD)}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), TOKENIZER).collect()
    assert check(rows, dict(zip(texts, expected_ids(texts.values())))) > 0.95


def test_ids_of_all_kinds_of_text():
    """The contract's tokenizer, as it is by default, and ours agree on mixed scripts, spaces, marks and added tokens."""
    rng = random.Random(3)
    bits = ["the", " of", "  ", "\n", "\t", "é", "漢字", "한국어", "😀", "1234", "'s", "'ll", "<|endoftext|>", "<|", "|>", "\u3000", "\u00a0", "a" * 300, "...", "-", "\x00", "\r\n", "ß", "İ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)] + [t or "" for t in ODD]
    encode = packing.encoder(*TOKENIZER)
    assert [[*encode(t).tolist(), 1] for t in texts] == expected_ids(texts)
    assert encode("x<|endoftext|>").tolist()[-1] == 50256


def test_patterns_cover_demand():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 65)
    demand = rng.integers(1, 500, 64)
    plan = packing.solve_patterns(sizes, demand, 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all(p @ sizes <= 64 for p, _ in plan)
    rooms = []  # by first fit decreasing
    for size in np.repeat(sizes, demand)[::-1]:
        at = next((i for i, room in enumerate(rooms) if room >= size), len(rooms))
        rooms[at : at + 1] = [(rooms[at] if at < len(rooms) else 64) - size]
    assert sum(t for _, t in plan) <= 1.002 * len(rooms) + 1


def test_odd_tables(spark):
    schema = "doc_id long, text string, length int, sequence_id string"
    assert packing.pack(spark.createDataFrame([], schema), TOKENIZER).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a b", 1, "x"), (1, "a b", 1, "x"), (None, None, 2, None)], schema), TOKENIZER).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert {r.sequence_id for r in rows} == {0}
    assert sorted(r.offset for r in rows)[0] == 0
    clash = spark.createDataFrame([(1, "a b", 7, "x"), (1, "c d", 8, "y")], "doc_id long, text string, cls int, rank string")
    assert sorted(r.offset for r in packing.pack(clash, TOKENIZER).collect()) == [0, 3]
