"""Embeddings of texts: a deterministic hashing embedding in SQL, or any function through a vectorised UDF."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diffs import embeddable

DIMENSION = 256


def hashed(text: Column, dimension: int = DIMENSION) -> Column:
    """Unit vector that counts a text's tokens by sha2 bucket; zeros for texts without tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), F.lit(0))
    buckets = F.transform(tokens, lambda t: (F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % dimension).cast("int"))
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dimension), lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))
    size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.when(size > 0, v / size).otherwise(0.0))


def token_buckets(texts: DataFrame, id_col: str, text_col: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, bucket, value): the non-zero coordinates of `hashed`, as rows, for long texts and large tables."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"\w+"), F.lit(0))
    rows = texts.select(F.col(id_col).alias("id"), F.explode(tokens).alias("t"))
    bucket = (F.conv(F.substring(F.sha2("t", 256), 1, 8), 16, 10).cast("long") % dimension).cast("int")
    n = rows.groupBy("id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return n.join(size, "id").select("id", "bucket", (F.col("n") / F.col("size")).alias("value"))


def with_model(model: Callable[[list[str]], list[list[float]]]):
    """A Column function from texts to vectors by a batch function, called once per Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model([x or "" for x in texts]))

    return run


def chunk_vectors(chunks: DataFrame, embed: Callable[[Column], Column] = hashed, dimension: int = DIMENSION) -> DataFrame:
    """Chunks (content, files) with `vector`: of the preprocessed content, of the joined file names where it is blank, zeros where there is neither."""
    own = embeddable(F.coalesce("content", F.lit("")))
    text = F.coalesce(F.when(F.trim(own) != "", own), F.array_join("files", " "))
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return chunks.withColumn("vector", F.coalesce(embed(text), zeros))
