"""Embedding of texts by a pluggable encoder, in batches on the executors."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A factory that a worker calls once; what it gives maps an array of texts to a matrix.
Encoder = Callable[[], Callable[[np.ndarray], np.ndarray]]


def hashed_words(dim: int = 64) -> Encoder:
    """An encoder without a model, for tests: signed word hashes, of unit length."""

    def make():
        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for word in str(text).lower().split():
                    h = zlib.crc32(word.encode())
                    out[i, h % dim] += 1 if h & 0x10000 else -1
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(lengths == 0, 1, lengths)

        return encode

    return make


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = 256) -> DataFrame:
    """`df` with the embedding of a text column; null texts count as empty."""
    encode = predict_batch_udf(encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))


def pending(chunks: DataFrame) -> DataFrame:
    """The chunks to embed: pending ones that aren't deleted."""
    return chunks.where((F.col("status") == "pending") & ~F.col("is_deleted"))


def precision_at(scores: Column, least: float = 0.1) -> Column:
    """The share of scores that reach a limit; null without scores."""
    return F.try_divide(F.size(F.filter(scores, lambda s: s >= least)).cast("double"), F.size(scores))


VECTORS = "key string, vector array<float>"


def remembered(df: DataFrame, text: str, encoder: Encoder, store: str, out: str = "embedding", batch: int = 256) -> DataFrame:
    """`df` with the embedding of a text column, of which only texts that `store` hasn't seen yet are encoded; these are added to it.

    `store` is a folder of vectors by a hash of the text; one for each encoder. Null texts count as empty. Two calls at once may both add a text, which does no harm.
    """
    spark = df.sparkSession
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    wanted = df.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["key"])
    spark.createDataFrame([], VECTORS).write.mode("append").parquet(store)  # so that there is a table
    fresh = wanted.join(spark.read.schema(VECTORS).parquet(store), "key", "left_anti")
    embed(fresh, "text", encoder, "vector", batch).select("key", "vector").write.mode("append").parquet(store)
    known = spark.read.schema(VECTORS).parquet(store).dropDuplicates(["key"]).select(F.col("key").alias("_key"), F.col("vector").alias(out))
    return df.join(known, key == F.col("_key")).drop("_key")
