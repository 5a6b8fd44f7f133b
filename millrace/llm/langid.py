"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit, a binary classifier over hashed letter n-grams says whether the language's bit
is 1: a naive Bayes classifier between the mean n-gram frequencies of the languages with a 1 and with a 0.
A text's evidence for all bits is compared with every codeword; the codeword of the smallest loss wins, bits weighing as much
as their classifier was right in training. Where the second best is close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, map_texts

#: Documents of each language, about, that the classifiers are fitted on.
FIT_ROWS = 2_000
#: Buckets of hashed n-grams; the n.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: Evidence of a bit counts for at most this many n-grams, so that a long text isn't surer than a page of it.
EVIDENCE = 300.0
#: A text whose best language leads by less is ambiguous.
MARGIN = 0.2

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a text's lower-cased letters, other characters between them as one space; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    letter = np.concatenate(([False], letter, [False]))
    points = np.where(letter, np.concatenate(([32], points, [32])), 32).astype(np.uint32)
    points = points[letter | np.concatenate(([True], letter[:-1]))]
    out, code = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] + np.uint32(n * 0x9E37))
        if n in ORDERS and len(code):
            out.append((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15))
    return np.concatenate(out).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1, far from each other: all ways to part up to 5 languages in two, else a random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(n)] for split in range(1, 1 << (n - 1))]
        return np.array(bits, float).T
    rng, width, best, apart = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    for _ in range(50):
        code = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(0)) < n]
        closest = ((code[:, None, :] != code[None, :, :]).sum(2) + np.eye(n, dtype=int) * width).min()
        if closest > apart:
            best, apart = code, closest
    return best


class Model:
    """Codewords, the classifiers' n-gram weights and the bits' weights."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        smooth = np.array([(counts[c] + 0.5) / (counts[c].sum() + 0.5 * BUCKETS) for c in self.langs]).reshape(len(self.langs), BUCKETS)
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        for bit in range(self.code.shape[1]):
            ones, zeros = smooth[self.code[:, bit] > 0], smooth[self.code[:, bit] < 0]
            if len(ones) and len(zeros):
                self.weights[:, bit] = np.log(ones.mean(0)) - np.log(zeros.mean(0))
        self.bits = np.ones(self.code.shape[1])

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log-odds of every bit, and its number of n-grams."""
        counts = np.zeros((len(texts), BUCKETS), np.float32)
        for i, text in enumerate(texts):
            counts[i] = np.bincount(ngrams(text), minlength=BUCKETS)
        n = counts.sum(1)
        return (counts @ self.weights) * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None], n

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Each text's probability of every language, from its codeword's loss."""
        loss = np.array([(np.logaddexp(0, -odds * word) * self.bits).sum(1) for word in self.code]).T / self.bits.sum() * 2
        likely = np.exp(loss.min(1, keepdims=True) - loss)
        return likely / likely.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and ambiguity of each text; `und` with 0 for those without letters, or if no language is known."""
        if not texts or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        odds, n = self.evidence(texts)
        likely = self.decode(odds)
        best = likely.argmax(1)
        ranked = np.sort(likely, 1)
        lead = ranked[:, -1] - (ranked[:, -2] if len(self.langs) > 1 else 0)
        langs = [self.langs[b] if k else "und" for b, k in zip(best, n)]
        return langs, np.where(n > 0, ranked[:, -1], 0.0), (lead < MARGIN) & (n > 0)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fitted on documents with a language: of each about `fit_rows`, chosen by hash, or all if there are fewer.

    Executors count n-grams; the driver gets at most BUCKETS counts a language.
    """
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per_lang = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    share = {lang: min(1.0, fit_rows / n) for lang, n in per_lang.items()}
    if not share:
        return Model({})
    limit = F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, int(10**12 * s))))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(10**12)) < F.element_at(limit, F.col("lang"))).select("text", "lang")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                found = np.bincount(ngrams(text.as_py()), minlength=BUCKETS)
                total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "bucket", "n"])

    cells = map_texts(sample, counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    found = {lang: np.zeros(BUCKETS) for lang in share}
    for lang, part in cells.groupby("lang"):
        found[lang][part.bucket.to_numpy()] = part.n.to_numpy()
    model = Model(found)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, n = np.zeros(model.code.shape[1]), 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                odds, k = model.evidence(part.column(0).to_pylist())
                word = model.code[[model.langs.index(x) for x in part.column(1).to_pylist()]]
                good, n = good + ((odds * word > 0) & (k > 0)[:, None]).sum(0), n + int((k > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([*good, n], pa.float64()), pa.array(range(len(good) + 1), pa.int32())], ["x", "i"])

    sums = {r.i: r.x for r in map_texts(sample, right, "x double, i int").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    n = max(sums.get(model.code.shape[1], 0), 1)
    model.bits = np.array([max(0.05, 2 * sums.get(i, 0) / n - 1) for i in range(model.code.shape[1])])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row; null texts and those without letters are `und` with score 0.

    Only the text counts; other columns, whatever their names, don't. Rows that repeat are judged alike. Ties go to the language that sorts first, and are
    ambiguous. Very long texts are judged as a whole. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                langs, scores, ambiguous = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(ambiguous, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is known and not ambiguous: null texts and those without letters go, rows that repeat stay."""
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                langs, _, ambiguous = model.predict(part.column(at_text).to_pylist())
                yield part.filter(pa.array([lang != "und" and not a for lang, a in zip(langs, ambiguous)], pa.bool_()))

    return map_rows(docs, run)
