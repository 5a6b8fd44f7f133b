"""The corpus pipeline: language ID, quality, near-duplicates, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of `documents`, and further columns that docs has, whatever their names and types.
Ids may be null or repeat: a row is told apart by its id and a hash of all its columns. Texts of any length are one document. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import copies, langid, mixing, packing, quality
from millrace.llm.common import crc_mod, cut, table
from millrace.llm.queries import tokenizer


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has letters and one clear language, as learned from those with a known language.

    Null and empty texts have no letters and go. Rows that repeat are judged alike. If no language is known, nothing stays.
    """
    return langid.keep(docs, langid.fit(docs.where(crc_mod("doc_id", 5) != 0)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, fitted on the labels, scores at 0.7 or more.

    Null and empty texts are scored like any other; rows that repeat are judged alike.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    return quality.keep(docs, quality.fit(docs, labels))


def named(column: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def hashable(field: T.StructField) -> Column:
    """A column as what Spark hashes; it doesn't hash maps and variants, which stand as JSON."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(named(field.name).alias("v"))) if "map<" in kind or "variant" in kind else named(field.name)


def key_of(docs: DataFrame) -> Column:
    """What tells rows apart, in the order in which they are preferred: rows with an id, the smallest id, then a hash of 128 bits of the row."""
    none, columns = F.col("doc_id").isNull(), [hashable(f) for f in docs.schema.fields]
    return F.struct(none.alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("2"), *columns).alias("h2"))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row, doc_id, text, source): the row's columns as one, so that no name of theirs clashes."""
    return docs.select(key_of(docs).alias("key"), F.struct(*map(named, docs.columns)).alias("row"), "doc_id", "text", "source")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the first in the order of `key_of`.

    Texts without words, null or empty, are one group. Rows that repeat an id with other texts are documents of their own.
    """
    rows = keyed(docs)
    chosen = cut(copies.near_copies(rows, "key").groupBy("root").agg(F.min("key").alias("key")).select("key"), "chosen")
    return rows.join(chosen.hint("merge"), "key").dropDuplicates(["key"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its source's complete epochs and the weighted sample.

    Texts without words are never taken. Rows equal in all columns share what all of them are given.
    """
    rows = keyed(docs)
    taken = mixing.mix(rows, carry=("key",)).where("taken > 0").groupBy("key").agg(F.sum(F.expr("taken div size")).cast("int").alias("times"))
    many = rows.join(cut(taken, "taken").hint("merge"), "key").dropDuplicates(["key"])
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, seated in sequences of 2048 tokens; of null and empty texts, the end."""
    return packing.pack(docs, tokenizer(), capacity=2048, end_id=1)


STAGES = [("language_id", languages), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]

#: The stages' classifiers, hashes and tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
