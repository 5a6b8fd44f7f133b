"""Phrases whose words stand together more often than their parts do, by language.

Every place of a text is a row with the words from there on; rows are counted by language and words. Words and pairs are counted in one job, words by the pairs
that they begin, and each longer length in one of its own, so no more than that is shuffled at a time; of phrases of two words and more only those that reach
`min_count` are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores are in millionths.
SCALE = 1_000_000
FIRST_MAP = "spark.sql.codegen.aggregate.map.twolevel.enabled"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Where lower() leaves what isn't ASCII alone, it is the fast way to this."""
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    plain = (F.octet_length(text) == F.length(text)) | (F.lower(rest) == rest)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(docs: DataFrame) -> DataFrame:
    """(end, words): a row for each piece of a text between marks `[.,;:!?\\x0A-\\x0D]`, with its words `[^\\x20\\x09]+`, A-Z lower-cased; `end` is a line end and the language.

    Outer explodes, as for others the optimizer adds a filter that splits every text a second time. A text of ASCII is lower-cased as a whole, others piece by piece.
    """
    text = F.replace("text", F.lit("\t"), F.lit(" "))
    ascii_only = F.octet_length("text") == F.length("text")
    end = F.concat(F.lit("\n"), F.coalesce("lang", F.lit("und")))
    low = docs.select(end.alias("end"), ascii_only.alias("done"), F.when(ascii_only, F.lower(text)).otherwise(text).alias("text"))
    part = low.select("end", "done", F.explode_outer(F.split("text", r"[.,;:!?\n-\r]")).alias("piece")).where("piece is not null")
    piece = F.when(F.col("done"), F.col("piece")).otherwise(lowered(F.col("piece")))
    return part.select("end", F.array_remove(F.split(piece, " "), "").alias("words"))


def windows(docs: DataFrame, shortest: int, longest: int) -> DataFrame:
    """key: from each place of a piece that has `shortest` words ahead of it the next `longest` words, or all if they are fewer, space-joined, with `end` behind them.

    Places are rows, so that keys are made by compiled code; lambdas over arrays are interpreted.
    """
    placed = pieces(docs).select("end", "words", F.posexplode_outer("words").alias("i", "word")).where(F.col("i") <= F.size("words") - shortest)
    ahead = [F.get("words", F.col("i") + k) for k in range(1, longest)]
    return placed.select(F.concat(F.concat_ws(" ", "word", *ahead), "end").alias("key"))


def starts(counts: DataFrame, lengths: tuple[int, ...], least: int) -> DataFrame:
    """(key, f) of all phrases of these lengths, from those of `windows`; of the longest only those with f >= least.

    One window begins at each place, so a phrase occurs as often as all windows that it begins.
    """
    longest = max(lengths)
    first = lambda m: F.substring_index("phrase", " ", m)
    whole = lambda m: F.lit(True) if m == 1 else first(m) != first(m - 1)
    found = [F.when(whole(m) & (F.lit(True) if m < longest else F.col("f") >= least), F.concat(first(m), "end")) for m in lengths]
    counts = counts.withColumn("phrase", F.substring_index("key", "\n", 1)).withColumn("end", F.substr("key", F.length("phrase") + 1))
    return counts.select("f", F.explode_outer(F.array(*found)).alias("key")).where("key is not null").groupBy("key").agg(F.sum("f").alias("f"))


def counted(docs: DataFrame, lengths: tuple[int, ...], least: int) -> DataFrame:
    """(lang, phrase, f) of all single words and of longer phrases with f >= least, of these lengths.

    Rows are counted by one key, phrase and language with a line end between them, which no phrase has: one string is cheaper to hash, compare and shuffle than two.
    """
    counts = windows(docs, min(lengths), max(lengths)).groupBy("key").agg(F.count("*").alias("f"))
    counts = (starts(counts, lengths, least) if len(lengths) > 1 else counts).withColumn("phrase", F.substring_index("key", "\n", 1))
    frequent = counts.where((F.col("f") >= least) | ~F.contains("phrase", F.lit(" ")))
    return frequent.select(F.substr("key", F.length("phrase") + 2).alias("lang"), "phrase", "f")


def written(docs: DataFrame, lengths: tuple[int, ...], least: int) -> DataFrame:
    """`counted` as a table. Spark's small first map of an aggregation only costs time where most keys are new, so it is off meanwhile."""
    spark = docs.sparkSession
    before = spark.conf.get(FIRST_MAP)
    spark.conf.set(FIRST_MAP, "false")
    try:
        return cut(counted(docs, lengths, least), "phrases")
    finally:
        spark.conf.set(FIRST_MAP, before)


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), in decimals of 38 digits: exact for counts below 1e16. It is at most SCALE, as no part is rarer than the whole."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    above, below = wide[0] * wide[0] * F.lit(SCALE).cast("decimal(7,0)"), wide[1] * wide[2]
    return F.call_function("div", above, below).cast("long")


def _part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def mine(docs: DataFrame, max_n: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `max_n` words that occur `min_count` times or more.

    `docs` has lang and text; other columns don't matter. n counts the language's words, a the phrase, l and r the parts of its lowest-scoring cut (of equal
    scores the cut after the fewest words). A phrase is left out if a longer one around it, of up to `max_n` words, has at least `covered` percent of its
    occurrences; as the phrases between the two are no rarer than the longer one, those of one word more decide. Order: score and a descending, phrase by its
    UTF-8 bytes. Null languages are `und`; null and empty texts have no words; texts that repeat count each time; texts of any length are cut into pieces
    before their phrases are listed. An empty table, or a language without frequent phrases, gives no rows.
    """
    counts = [written(docs, lengths, min_count) for lengths in [(1, 2), *((n,) for n in range(3, max_n + 1))]]
    parts = reduce(DataFrame.unionByName, counts).where(F.col("f") >= min_count)
    words = parts.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")
    split = words.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    split = split.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, size).alias("right"))
    lefts = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = split.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the phrases one word shorter at either end of each phrase, with the most frequent phrase around them
    inner = words.where(size > 2).select("lang", "a", F.explode(F.array(_part(1, size - 1), _part(2, size - 1))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = worst.join(around, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {covered} * a"))

    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts[0].where(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM d),
g AS (SELECT lang, unnest(ws) AS phrase, 1 AS m FROM w
      UNION ALL SELECT lang, ws[i] || ' ' || ws[i+1], 2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)
      UNION ALL SELECT lang, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2], 3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
k AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k+1:], ' ') AS q FROM (SELECT c.*, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, k.a::HUGEINT * k.a * 1000000 // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.p JOIN f y ON y.lang = k.lang AND y.phrase = k.q),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS MATERIALIZED (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE m = 3),
y AS MATERIALIZED (SELECT lang, phrase, max(a) AS longer FROM x GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(n.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
