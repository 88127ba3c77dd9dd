"""Text to vectors: a user's model in batches, or hashed words without any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.bind import let

BATCH = 32
HASH_DIM = 256


def embed(
    df: DataFrame, text: str, model: Callable[[Sequence[str]], tuple[Sequence[Sequence[float]], int]], batch: int = BATCH
) -> DataFrame:
    """Add `embedding` and `usage_tokens` from a model that maps a list of texts to (vectors, tokens used).

    The tokens of a call are booked on its first row, so that their sum over any rows that came in
    whole calls is the total. `model` is sent to the tasks once; let it set itself up on first use.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("usage_tokens", T.LongType())]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                vectors, used = model(part[text].tolist())
                part["embedding"] = [list(v) for v in vectors]
                part["usage_tokens"] = [int(used)] + [0] * (len(part) - 1)
                yield part

    return df.mapInPandas(run, schema)


def total_usage(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.coalesce(F.sum("usage_tokens"), F.lit(0)).alias("usage_tokens"), F.count("*").alias("n_texts"))


def hash_buckets(text: Column, dim: int = HASH_DIM) -> Column:
    """Distinct buckets of the distinct lower-case words of three letters or more."""
    if dim & (dim - 1) or not 16 <= dim <= 1 << 28:
        raise ValueError("the dimension must be a power of two from 16 to 2**28")
    digits = 7
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0))
    tail = lambda w: F.conv(F.right(F.md5(F.encode(w, "UTF-8")), F.lit(digits)), 16, 10).cast("bigint")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(tail(w), F.lit(dim)).cast("int")))


def hash_embed(text: Column, dim: int = HASH_DIM) -> Column:
    """Unit-length bag of hashed words."""

    def dense(hits: Column) -> Column:
        # Runs of zeros between the sorted hits: linear in dim, with no search per component.
        unit = F.lit(1.0) / F.sqrt(F.greatest(F.size(hits), F.lit(1)).cast("double"))
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.element_at(hits, F.greatest(i, F.lit(1))))
        runs = F.transform(hits, lambda h, i: F.concat(F.array_repeat(F.lit(0.0), h - before(i) - 1), F.array(unit)))
        tail = F.array_repeat(F.lit(0.0), F.lit(dim - 1) - F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(-1)))
        return F.concat(F.flatten(runs), tail)

    return let(F.array_sort(hash_buckets(text, dim)), dense)


def check_dim(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fail the job on the first vector of another dimension."""
    return df.filter(
        F.when(F.size(column) == dim, True).otherwise(
            F.raise_error(F.concat(F.lit(f"vector dimension is not {dim}: "), F.size(column).cast("string")))
        )
    )


def dim_report(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Counts of vectors and of vectors with another dimension than configured."""
    return df.agg(
        F.count("*").alias("n_points"),
        F.count_if(F.coalesce(F.size(column), F.lit(-1)) != dim).alias("n_wrong"),
    ).withColumn("expected_dim", F.lit(dim).cast("bigint"))
