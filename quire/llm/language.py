"""Language ID by hyperdimensional letter-trigram profiles.

Every letter has a random bipolar vector. A trigram is the product of its letters' vectors, each
rotated by the letter's place (binding); a text is the sum of its trigrams (bundling); a language is
the sum of its labelled texts. A text takes the language whose vector has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import small_batches

WIDTH = 1024  # components of a vector
LETTERS = 64  # 0 is everything but letters, 1-26 are a-z, the rest is shared by the other letters
SEED = 20240229
UNKNOWN = "und"
MAX_LANGUAGES = 1000  # labels; their vectors are held by every task
TABLES = 32  # labels whose trigrams a task counts at a time
BLOCK = 4096  # trigrams bound at once


@functools.cache
def _letter_codes() -> np.ndarray:
    """Letter code of every code point."""
    codes = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            codes[point] = 27 + point % (LETTERS - 27)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return codes


@functools.cache
def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the letters at the first, second and third place of a trigram."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, WIDTH))
    return base, np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letter_codes()[points]


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams of the words, padded by a gap, and their counts; None without a letter."""
    codes = _codes(text)
    if not codes.any():
        return None
    codes = np.concatenate(([0], codes, [0])).astype(np.int64)
    gap = codes == 0
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]  # one gap between words
    if len(codes) < 3:
        return None
    grams = (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
    grams = grams[codes[1:-1] != 0]
    return np.unique(grams, return_counts=True)


def _bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors, exact in 64-bit integers."""
    first, second, third = _letter_vectors()
    total = np.zeros(WIDTH, np.float64)
    for at in range(0, len(grams), BLOCK):
        g = grams[at : at + BLOCK]
        bound = first[g // (LETTERS * LETTERS)] * second[g // LETTERS % LETTERS] * third[g % LETTERS]
        # Counts of one block stay below 2**24, so single precision is exact there.
        n = counts[at : at + BLOCK]
        kind = np.float32 if n.sum() < 1 << 24 else np.float64
        total += n.astype(kind) @ bound.astype(kind)
    return total.astype(np.int64)


def learn(labelled: DataFrame, tables: int = TABLES) -> dict[str, np.ndarray]:
    """Unit vector of each label of (text, lang); rows where either is null or has no letter add nothing.

    Every task sends one vector of WIDTH whole numbers per label, so the result does not depend on the
    order of rows. A task holds the trigram counts of at most `tables` labels (2 MB each); further labels have
    those bundled first, which gives the same sums. What reaches the driver is MAX_LANGUAGES vectors at most; more labels raise.
    """

    small_batches(labelled.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        vectors: dict[str, np.ndarray] = {}

        def fold() -> None:
            for lang, n in counts.items():
                grams = np.flatnonzero(n)
                vectors[lang] = vectors.get(lang, 0) + _bundle(grams, n[grams])
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                found = _trigrams(text)
                if found is not None:
                    if lang not in counts:
                        if len(counts) >= tables:
                            fold()
                        counts[lang] = np.zeros(LETTERS**3, np.int64)
                        if len(counts.keys() | vectors.keys()) > MAX_LANGUAGES:
                            raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    counts[lang][found[0]] += found[1]
        fold()
        for lang, vector in vectors.items():
            yield pd.DataFrame({"lang": [lang], "vector": [vector.tolist()]})

    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    parts = rows.mapInPandas(partial, "lang string, vector array<bigint>")
    each = parts.select("lang", F.posexplode("vector").alias("at", "x"))
    sums = each.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = (
        sums.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
        .select("lang", F.col("v.x").alias("v"))
        .limit(MAX_LANGUAGES + 1)
        .collect()
    )
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vectors = {r["lang"]: np.array(r["v"], np.float64) for r in found}
    return {lang: v / (np.linalg.norm(v) or 1.0) for lang, v in sorted(vectors.items())}


def predict(text: str | Column, profiles: dict[str, np.ndarray]) -> Column:
    """Struct (lang, score) of a text column: nearest profile and its cosine, between 0 and 1.

    Null, empty and letterless texts, and any text when no profile is known, give (`und`, 0.0). Of
    equal cosines the alphabetically first language is taken. The whole text counts, however long.
    """
    names = list(profiles)
    matrix = np.array([profiles[n] for n in names], np.float64).reshape(len(names), WIDTH)

    def one(value: str | None) -> tuple[str, float]:
        found = _trigrams(value) if value and names else None
        if found is None:
            return UNKNOWN, 0.0
        vector = _bundle(*found).astype(np.float64)
        cosines = matrix @ vector / (np.linalg.norm(vector) or 1.0)
        best = int(np.argmax(cosines))
        return names[best], float(min(1.0, max(0.0, cosines[best])))

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(v if isinstance(v, str) else None) for v in batch]
            yield pd.DataFrame(got, columns=["lang", "score"])

    return run(F.col(text) if isinstance(text, str) else text)


def has_letter(text: str | Column) -> Column:
    """Whether a text has a letter, which is when a language can be told for it; false for null."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([isinstance(v, str) and any(map(str.isalpha, v)) for v in batch], dtype=bool)

    return run(F.col(text) if isinstance(text, str) else text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its number as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents, learnt from those not held out.

    One row per input row, repeated ones too; a null doc_id counts as not held out. Other columns of
    the input are ignored.
    """
    slim = docs.select("doc_id", "text", "lang")
    profiles = learn(slim.where(~held_out()))
    guess = slim.select("doc_id", held_out().alias("held_out"), predict("text", profiles).alias("p"))
    return guess.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))
