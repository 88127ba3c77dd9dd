"""Work whose failures stay with their rows: an error column instead of a failed job."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.embedding import BATCH

MAX_ERROR = 500
MAX_CELLS = 100_000  # of one grid


def embed_captured(
    df: DataFrame, text: str, model: Callable[[Sequence[str]], tuple[Sequence[Sequence[float]], int]], dim: int, batch: int = BATCH
) -> DataFrame:
    """Add `embedding`, `usage_tokens` and `error`, of which either the first or the last is null.

    `model` is called as in `embedding.embed`. If a call raises, or gives another number of vectors than it
    got texts, its texts are tried one by one, so only those that fail by themselves have an error. A vector
    with another dimension than `dim`, or with a null or non-finite component, is an error of its row, too.
    A null text is an error and does not reach the model.
    """
    schema = T.StructType([
        *df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("usage_tokens", T.LongType()), T.StructField("error", T.StringType())
    ])

    def fault(vector: Sequence[float]) -> str | None:
        if len(vector) != dim:
            return f"vector dimension is not {dim}: {len(vector)}"
        if not all(v is not None and math.isfinite(v) for v in vector):
            return "vector has a component that is not a finite number"
        return None

    def call(texts: list[str]) -> tuple[list, int]:
        vectors, used = model(texts)
        vectors = [list(v) for v in vectors]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors, int(used)

    def told(texts: list) -> list[tuple]:
        good = [t for t in texts if isinstance(t, str)]
        try:
            vectors, used = call(good) if good else ([], 0)
            done = [(v, used if n == 0 else 0, None) for n, v in enumerate(vectors)]
        except Exception as e:  # the model is the user's: whatever it raises belongs to the rows
            if len(good) > 1:
                done = [told([t])[0] for t in good]
            else:
                done = [(None, 0, f"{type(e).__name__}: {e}"[:MAX_ERROR])]
        each = iter(done)
        rows = [next(each) if isinstance(t, str) else (None, 0, "text is null") for t in texts]
        return [(None, n, error or fault(v)) if error or fault(v) else (v, n, None) for v, n, error in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                part["embedding"], part["usage_tokens"], part["error"] = zip(*told(part[text].tolist()), strict=True)
                yield part

    return df.mapInPandas(run, schema)


def _bad(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def words_error(words: Column) -> Column:
    """What is wrong with the words (x0, x1, top, text) of a page; null if nothing is."""
    bad = F.filter(words, lambda w: w.isNull() | w["text"].isNull() | _bad(w["x0"]) | _bad(w["x1"]) | _bad(w["top"]) | (w["x1"] < w["x0"]))
    return F.when(F.size(bad) > 0, F.concat(F.lit("words without a place: "), F.size(bad).cast("string")))


def edges_error(edges: Column) -> Column:
    """What is wrong with the rules (orientation, x0, x1, top, bottom) of a page; null if nothing is."""
    bad = F.filter(edges, lambda e: e.isNull() | _bad(e["x0"]) | _bad(e["x1"]) | _bad(e["top"]) | _bad(e["bottom"]))
    return F.when(F.size(bad) > 0, F.concat(F.lit("rules without a place: "), F.size(bad).cast("string")))


def grid_error(matrix: Column) -> Column:
    """What is wrong with a raw grid; null if nothing is."""
    cells = F.aggregate(matrix, F.lit(0).cast("bigint"), lambda n, row: n + F.coalesce(F.size(row), F.lit(0)))
    return (
        F.when(matrix.isNull(), "grid is null")
        .when(F.exists(matrix, lambda row: row.isNull()), "grid has a null row")
        .when(cells > MAX_CELLS, F.concat(F.lit(f"grid has over {MAX_CELLS} cells: "), cells.cast("string")))
    )


def parted(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, without that column; rows with one)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())
