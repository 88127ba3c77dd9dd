"""Target-distribution importance resampling over hashed word runs.

Every run of one to three words is a feature, hashed into a bucket. A bucket's gain is the logarithm of
its share in the target over its share in the documents; a document's weight is the sum of the gains of
its features, looked up in one array. A seeded noise by doc_id is added, and the highest scores are drawn.

The score of the last drawn row is found by bracketing: a quantile sketch proposes a bracket, exact counts
outside it validate it or widen it, and only the rows in the bracket are sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import files_for, small_batches, written

BUCKETS = 10_000  # one array of gains goes to every task; the number is a parameter
SCALE = 1000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
SORTED_ROWS = 50_000  # a bracket of more rows is narrowed before it is sorted
RANKED_ROWS = 500_000  # rows of one task when ranks are given
ACCURACY = 10_000  # of the quantile sketch: ranks are right to one part in this number
SLACK = 0.001  # half width of a proposed bracket, as a share of the rows
TILE = 1 << 17  # words of a text that are hashed at once

# Bytes outside words become spaces, A-Z become a-z; every byte of a character beyond ASCII is in a word.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if isinstance(text, str) else []


def feature_buckets(words: list[bytes], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of one to three words, in arrays of bounded length.

    The checksum of a run continues that of the run without its last word, so no run is put together.
    """
    for begin in range(0, len(words), TILE):
        own = words[begin : begin + TILE + 2]
        first = min(len(own), TILE)  # runs that start in this tile
        spaced = [b" " + w for w in own]
        one = list(map(crc32, own))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        yield np.array(one[:first] + two[:first] + three[:first], np.uint32) % np.uint32(buckets)


def n_features(n_words: int) -> int:
    return n_words + max(n_words - 1, 0) + max(n_words - 2, 0)


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts of `texts` (text). Each task adds up its own texts; as many
    sums as there are buckets reach the driver."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for found in feature_buckets(split_words(text), buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    sums = texts.select("text").mapInPandas(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down; each bucket counts one feature more than it has."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    up, down = float(s_all + buckets), float(t_all + buckets)
    return np.array([math.floor(SCALE * math.log((t + 1) * up / ((s + 1) * down))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document in thousandths, rounded down; a null doc_id is hashed as an empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per input row; null texts have no words."""
    small_batches(docs.sparkSession)
    buckets = len(gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = split_words(text)
                weight = sum(int(gain[found].sum()) for found in feature_buckets(own, buckets))
                name = None if pd.isna(doc_id) else int(doc_id)
                out.append((name, len(own), n_features(len(own)), weight, weight + noise(name, seed)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_features", "weight", "score"])
            yield frame.astype({"doc_id": "Int64"})

    # A name leaves Spark as a string, so that nulls beside it do not make it a floating number.
    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


@dataclass(frozen=True)
class Cut:
    """Value of the last row that is taken, and how many rows with that value are taken."""

    value: int
    taken: int


def _sketch(rows: DataFrame, key: str, shares: list[float]) -> list[int]:
    return rows.agg(F.percentile_approx(key, shares, ACCURACY)).first()[0]


def bracketed(rows: DataFrame, key: str, wanted: int, sorted_rows: int = SORTED_ROWS, sketch: Callable = _sketch) -> Cut:
    """The value of the `wanted`-th smallest row by the integer column `key`; a row counts `times` times.

    The bracket [low, high] always holds the wanted row, by exact counts of the rows below it and in it.
    A quantile sketch of these rows proposes a narrower one, and the rows on both sides of it are counted:
    if the wanted row is not inside, the bracket is widened to the side where it is. When at most
    `sorted_rows` rows, or one value, are left, only these are sorted. After a proposal that has left more
    than half of the rows the values are halved, so the search ends whatever the sketch proposes.
    """
    low, high, inside = rows.agg(F.min(key), F.max(key), F.sum("times")).first()
    below, halve = 0, False
    if inside is None or not 1 <= wanted <= inside:
        raise ValueError(f"no row of rank {wanted}")
    while inside > sorted_rows and low < high:
        own = rows.where(F.col(key).between(low, high))
        share = (wanted - below) / inside
        a, b = sketch(own, key, [max(share - SLACK, 0.0), min(share + SLACK, 1.0)])
        a = min(max(a, low), high)
        b = max(min(b, high), a)
        if halve or (a, b) == (low, high):
            a, b = low, (low + high) // 2
        was = inside
        under, held = own.agg(
            F.sum(F.when(F.col(key) < a, F.col("times")).otherwise(0)), F.sum(F.when(F.col(key).between(a, b), F.col("times")).otherwise(0))
        ).first()
        if wanted <= below + under:
            high, inside = a - 1, under
        elif wanted > below + under + held:
            low, below, inside = b + 1, below + under + held, inside - under - held
        else:
            low, high, below, inside = a, b, below + under, held
        halve = 2 * inside > was
    if low < high:
        values = rows.where(F.col(key).between(low, high)).groupBy(key).agg(F.sum("times").alias("n")).orderBy(key)
        for value, n in values.collect():  # at most sorted_rows
            if below + n >= wanted:
                low = value
                break
            below += n
    return Cut(int(low), wanted - below)


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, sorted_rows: int = SORTED_ROWS, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of `scored`, ranked from 1 if it is drawn.

    Of the N rows with at least `min_words` words, the floor(percent * N / 100) with the highest scores are
    drawn, ties to the smaller doc_id (null last), then to fewer features; of equal rows as many are drawn
    as there is room for. Equal rows are counted and are one row until the end, so they make no large
    group. An empty table gives no rows, and fewer than 100 / `percent` rows give no rank.
    """
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    rows = written(
        scored.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("times"))
        .select(*names, "times", (-F.col("score")).alias("by_score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("by_doc"), F.col("n_features").alias("by_features")),
        "scored",
    )
    order = ("by_score", "by_doc", "by_features")
    able = rows.where(F.col("n_words") >= min_words)
    left = percent * (able.agg(F.sum("times")).first()[0] or 0) // 100
    if not left:
        return _listed(rows.withColumn("rest", F.col("times")))
    tied, last = able, []
    for key in order:
        cut = bracketed(tied, key, left, sorted_rows)
        tied, left = tied.where(F.col(key) == cut.value), cut.taken
        last.append((key, cut.value))
    # Rows that agree in all of the order are equal rows, so one row is left in the tie.
    before, level = F.lit(False), F.lit(True)
    for key, value in last:
        before, level = before | (level & (F.col(key) < value)), level & (F.col(key) == value)
    taken = F.when(F.col("n_words") < min_words, 0).when(before, F.col("times")).when(level, F.lit(left)).otherwise(0)
    rows = rows.withColumn("taken", taken.cast("bigint"))
    drawn = rows.where("taken > 0")
    parts = files_for(drawn.count(), ranked_rows)
    # Written once, so that the bounds of the parts are the same for the sums and for the ranks.
    ranged = written(drawn.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "drawn")
    sums = ranged.groupBy("part").agg(F.sum("taken").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("taken").over(upto)).join(bases, "part")
    end = F.col("base") + F.col("upto")
    ranked = placed.select("doc_id", "n_features", "weight", "score", F.explode(F.sequence(end - F.col("taken") + 1, end)).alias("rank"))
    return ranked.union(_listed(rows.withColumn("rest", F.col("times") - F.col("taken"))))


def _listed(rows: DataFrame) -> DataFrame:
    """Rows that are not drawn, `rest` times each."""
    each = rows.where("rest > 0").select("doc_id", "n_features", "weight", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rest"))).alias("time"))
    return each.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`, drawn towards the texts of `target`.

    Null and empty texts have no feature, weight 0 and no rank. Very long texts are hashed whole, a tile at
    a time. Repeated rows are rows of their own, with equal scores. With an empty target every bucket has
    the same share there. Other columns are ignored. Scores are written to the shared folder once.
    """
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    return draw(written(weights(docs, gain, seed), "weights"), percent, min_words)


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
