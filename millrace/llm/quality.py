"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each text gives a few counts, as logarithms and log-odds. Each class of labelled documents gives a mean and a
covariance, shrunk towards the pooled one; their Cholesky factors are computed once. A text's score is the logistic function of
the difference of the classes' log densities (from Mahalanobis distances) and of their priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, map_texts

#: Labelled documents, about, that the classifier is fitted on.
FIT_ROWS = 20_000
#: Weight of the pooled covariance in each class's own; share of its diagonal that is added.
SHRINKAGE, RIDGE = 0.5, 1e-3


def _log_odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole, part) - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed counts of a whole text; null counts as empty.

    Length, word length, shares of distinct words, capitals, digits, symbols and commas or stops, of the most
    frequent word, of distinct word pairs and of repeated lines, and words in a line.
    """
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    capitals, small, other, digits = (int(count[a:b].sum()) for a, b in ((65, 91), (97, 123), (128, 256), (48, 58)))
    shown = len(data) - int(count[32] + count[9:14].sum())
    stops = int(count[44] + count[46])
    symbols = shown - capitals - small - other - digits - stops
    n = len(words)
    top = max(Counter(words).values()) if words else 0
    return [
        float(np.log1p(n)),
        float(np.log((len(data) + 1) / (n + 1))),
        _log_odds(len(set(words)), n),
        _log_odds(capitals, shown),
        _log_odds(digits, shown),
        _log_odds(symbols, shown),
        _log_odds(stops, n + stops),
        _log_odds(top, n),
        _log_odds(len(set(zip(words, words[1:]))), max(n - 1, 0)),
        float(np.log(len(lines) / len(set(lines)))),
        float(np.log((n + 1) / len(lines))),
    ]


N_STATISTICS = len(statistics(""))


class Discriminant:
    """Class means, log priors and Cholesky factors of the shrunken covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """moments: for each class its number of rows, sum of vectors and sum of outer products."""
        self.classes = {}
        if not moments:
            return
        total = sum(n for n, _, _ in moments.values())
        means = {c: s / n for c, (n, s, _) in moments.items()}
        scatter = {c: p - n * np.outer(means[c], means[c]) for c, (n, _, p) in moments.items()}
        pooled = sum(scatter.values()) / max(total - len(moments), 1)
        ridge = np.diag(RIDGE * np.diag(pooled) + 1e-6)
        for c, (n, _, _) in moments.items():
            own = scatter[c] / max(n - 1, 1)
            factor = np.linalg.cholesky((1 - SHRINKAGE) * own + SHRINKAGE * pooled + ridge)
            self.classes[c] = (means[c], np.linalg.inv(factor), float(np.log(n / total) - np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row; the only class's own if just one was seen, 0.5 without any."""
        if set(self.classes) != {0, 1}:
            return np.full(len(x), {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(self.classes)])
        density = {c: base - 0.5 * (((x - mean) @ whiten.T) ** 2).sum(1) for c, (mean, whiten, base) in self.classes.items()}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fitted on the labelled documents, or on about `fit_rows` of them, chosen by hash, if there are more.

    `labels` has doc_id and quality; other values than 0 and 1 are left out, and of an id labelled more than once the largest label counts. Executors reduce the
    documents to sums; what reaches the driver is a few numbers a class and partition.
    """
    labels = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").cast("int").alias("quality"))
    n = labels.count()
    if n > fit_rows:
        labels = labels.where(F.pmod(F.xxhash64("labelled"), F.lit(10**12)) < int(10**12 * fit_rows / n))
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), F.col("doc_id") == F.col("labelled"))  # about fit_rows rows at most

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for text, quality in zip(b.column(0), b.column(1).to_pylist()):
                x = np.array([1.0, *statistics(text.as_py())])
                total[quality] = total.get(quality, 0) + np.outer(x, x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], ["quality", "m"])

    parts = map_texts(sample.select("text", "quality"), sums, "quality int, m array<double>")
    cells = parts.select("quality", F.posexplode("m").alias("i", "x")).groupBy("quality", "i").agg(F.sum("x").alias("x")).collect()
    moments = {}
    for c in sorted({r.quality for r in cells}):
        m = np.zeros((N_STATISTICS + 1) ** 2)
        for r in cells:
            if r.quality == c:
                m[r.i] = r.x
        m = m.reshape(N_STATISTICS + 1, -1)
        moments[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return Discriminant(moments)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts are scored like any other, rows that repeat alike.

    Only the text counts; other columns don't. Null ids stay null. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t.as_py()) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all their columns, that score at least `threshold`; a score equal to it suffices, rows that repeat are judged alike."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t.as_py()) for t in b.column(names.index("text"))])
                yield b.filter(pa.array(model.scores(x) >= threshold))

    return map_rows(docs, run)
