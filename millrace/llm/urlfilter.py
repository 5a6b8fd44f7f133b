"""URL rules by a Bloom filter cascade over the corpus's own keys.

A rule is a host and a path, written together (`example.com/en/`). A url's keys are its host and every parent
domain, each joined with the url's path cut to each length that a rule's path has: if a rule fits a url, the rule is one of
the url's keys. The cascade is built against all distinct keys of the corpus: level 1 holds the rules, level 2 the other keys
that level 1 takes for rules, level 3 the rules that level 2 takes for those, and so on until a level takes none. The
depth of the first level that lacks a key then says exactly, for every key of the corpus, whether it is a rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

#: Rules, at most, as they are values in the plan; tested up to 2000.
MAX_RULES = 10_000
#: Share of foreign keys that a level after the first takes for its own.
LEVEL_ERROR = 0.5


class Bloom:
    """Bits for keys given as pairs of 64-bit hashes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, error: float, level: int):
        self.level, self.k = level, max(1, round(-math.log2(error)))
        self.m = max(64, math.ceil(1.45 * len(h1) * self.k))
        self.bits = np.zeros(-(-self.m // 8), np.uint8)
        for at in self._at(h1, h2):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, h1: np.ndarray, h2: np.ndarray):
        a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        for i in range(self.k):
            mixed = a + np.uint64(self.level * 64 + i) * b
            mixed ^= mixed >> np.uint64(31)
            yield (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(self.m)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self._at(h1, h2):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def in_cascade(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the parity of the first level that lacks them."""
    listed, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for level in levels:
        here = level.has(h1, h2)
        listed[open_ & ~here] = level.level % 2 == 0
        open_ &= here
    listed[open_] = len(levels) % 2 == 1
    return listed


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.reverse(key), key).alias("h2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Both empty without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _keys(host: Column, path: Column, lengths: list[int], deepest: int) -> Column:
    """The keys of a url: its host and parent domains of `deepest` labels at most, with each prefix of the path that is as long as a rule's path."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.size(labels) - deepest + 1, F.lit(1))
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p)))))


def build_cascade(universe: DataFrame, rules: list[str]) -> list[Bloom]:
    """Levels for `rules` against the distinct keys (h1, h2) of `universe`.

    The first level's error is set so that about as many foreign keys pass it as there are rules, whatever the
    size of the universe, so what the driver gets of them is bounded by the rules.
    """
    spark = universe.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, rules))).alias("key")).select(*_hashes(F.col("key"))).toPandas()
    own = listed.h1.to_numpy(), listed.h2.to_numpy()
    n = universe.count()
    levels = [Bloom(*own, min(LEVEL_ERROR, len(rules) / max(n, 1)), 1)]
    first = levels[0]

    def passing(batches):
        listed = set(zip(*(h.tolist() for h in own)))
        for pdf in batches:
            h1, h2 = pdf.h1.to_numpy(), pdf.h2.to_numpy()
            hit = np.flatnonzero(first.has(h1, h2))
            yield pdf.iloc[[i for i in hit if (h1[i], h2[i]) not in listed]]

    foreign = universe.mapInPandas(passing, "h1 long, h2 long").toPandas()
    inside, outside = own, (foreign.h1.to_numpy(np.int64), foreign.h2.to_numpy(np.int64))
    while len(outside[0]):
        levels.append(Bloom(*outside, LEVEL_ERROR, len(levels) + 1))
        hit = levels[-1].has(*inside)
        inside, outside = outside, tuple(h[hit] for h in inside)
        if len(levels) > 200:
            raise RuntimeError("the cascade does not end: two keys share both hashes")
    return levels


def judge(pages: DataFrame, rules: dict[str, str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    `rules` maps a host and path, written together, to a verdict. The longest rule that fits wins; without one
    the rule is null and the verdict is `default`, which is also what null and malformed urls get. Rows that
    repeat are judged alike. An empty table gives an empty one.
    """
    if not rules or len(rules) > MAX_RULES:
        raise ValueError(f"between 1 and {MAX_RULES} rules, please")
    lengths = sorted({len(r) - r.index("/") for r in rules})
    deepest = max(r[: r.index("/")].count(".") + 1 for r in rules)  # a domain of more labels is in no rule
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", _keys(F.col("host"), F.col("path"), lengths, deepest))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct().select(*_hashes(F.col("key"))), "keys")
    levels = build_cascade(universe, list(rules))

    @F.pandas_udf("array<boolean>")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        flat = in_cascade(levels, np.concatenate(h1.to_numpy()).astype(np.int64), np.concatenate(h2.to_numpy()).astype(np.int64))
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]))

    # a filter on the result would be pushed down to where the cascade can't be evaluated, if Spark took it for deterministic
    listed = listed.asNondeterministic()
    hashes = [F.transform("keys", lambda k: _hashes(k)[0]), F.transform("keys", lambda k: _hashes(k)[1])]
    tested = keyed.withColumn("hit", listed(*hashes))
    fitting = F.transform(F.filter(F.arrays_zip("keys", "hit"), lambda x: x["hit"]), lambda x: F.struct(F.length(x["keys"]).alias("n"), x["keys"].alias("key")))
    ruled = tested.withColumn("rule", F.array_max(fitting)["key"])
    blocked = [r for r, v in rules.items() if v != default]
    verdicts = F.create_map(*(F.lit(x) for r in blocked for x in (r, rules[r]))) if blocked else None
    verdict = F.coalesce(F.try_element_at(verdicts, "rule"), F.lit(default)) if blocked else F.lit(default)
    return ruled.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.lit(default)).otherwise(verdict).alias("verdict"))
