"""Near-duplicate join on word 5-gram sets by MinHash banding.

Texts with equal sets are one class and go on once. Each class's MinHash signature is cut into bands; classes
meet where a band is equal, and every meeting is verified on the full sets. Small buckets send pairs;
large ones are cut into blocks by size, and block pairs return link counts and a spanning forest, so the
rows made stay linear in a group of near copies however many links it has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.registry import query, table
from quire.llm.shared import files_for, small_batches, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs exactly at the threshold; more similar pairs are found more surely
MOST_ROWS = 128  # values of a signature at most
SEED = 20240301
SMALL = 32  # members of a bucket whose pairs are sent one by one
BLOCK_BYTES = 4 << 20  # sets of a block of a larger bucket
TILE = 256
KEPT_WORDS = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most: int = MOST_ROWS) -> tuple[int, int]:
    """Bands and rows: the most rows per band, so the fewest false meetings, that find a pair at the
    threshold with the wanted probability within `most` values."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach this recall")


class Shingler:
    """Sets of hashed word n-grams; words are hashed once per task and remembered."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def _word(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        self.known[word] = value
        return value

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words than the n-gram is one gram, one
        without words has none."""
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known, one = self.known, self._word
        h = np.array([known[w] if w in known else one(w) for w in words], np.uint64)
        n = min(self.words, len(h))
        grams = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            grams = grams * _STEP + h[i : len(h) - n + 1 + i]
            grams ^= grams >> np.uint64(31)
        return np.unique(grams)


def _bands(grams: np.ndarray, factors: np.ndarray, bands: int) -> np.ndarray:
    """Hash of each band of the MinHash signature."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048, None] * factors[None, :]
        low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0))
    rows = low.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in rows.T:
        out = (out ^ column) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def row_key() -> Column:
    """Names a row by doc_id and text, with a null doc_id too; rows with equal keys are copies."""
    return F.xxhash64("doc_id", "text")


def _signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row_key, set_id, n_bytes, bands) of documents; set_id is null without words."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("set_id binary, n_bytes int, bands array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = Shingler(words)
        for batch in batches:
            out = []
            for text in batch:
                grams = tool.grams(text if isinstance(text, str) else None)
                if len(grams):
                    out.append((_set_id(grams), 8 * len(grams), _bands(grams, factors, bands).astype(np.int64)))
                else:
                    out.append((None, 0, None))
            yield pd.DataFrame(out, columns=["set_id", "n_bytes", "bands"])

    signed = docs.select("doc_id", row_key().alias("row_key"), sign("text").alias("s"))
    return signed.select("doc_id", "row_key", "s.set_id", "s.n_bytes", "s.bands")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, grams) of the wanted sets, from the row of each (set_id, row_key)."""

    @F.pandas_udf("id binary, grams binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = Shingler(words)
        for batch in batches:
            made = (tool.grams(text if isinstance(text, str) else None) for text in batch)
            yield pd.DataFrame([(_set_id(g), g.tobytes()) for g in made], columns=["id", "grams"])

    texts = docs.select(row_key().alias("row_key"), "text").join(wanted, "row_key")
    # Not deterministic by name only: the sets are to be made after the join, of the wanted texts alone.
    made = texts.withColumn("g", of.asNondeterministic()("text")).where(F.col("g.id") == F.col("set_id")).select("set_id", F.col("g.grams").alias("grams"))
    return made.dropDuplicates(["set_id"])


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    least, most = sorted((len(a), len(b)))
    if least < threshold * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (least + most - both) - 1e-9


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of `a` with every set of `b`, by incidence matrices over
    the grams both sides hold."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat)
        held = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == flat)
        return owner[held], at[held]

    if not len(common):
        return out
    (owner_a, at_a), (owner_b, at_b) = places(flat_a, a), places(flat_b, b)
    for low in range(0, len(common), 8192):
        width = min(8192, len(common) - low)
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        use_a, use_b = (at_a >= low) & (at_a < low + width), (at_b >= low) & (at_b < low + width)
        left[owner_a[use_a], at_a[use_a] - low] = 1
        right[owner_b[use_b], at_b[use_b] - low] = 1
        out += left @ right.T
    return out


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _block_links(own: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts and a spanning forest of one pair of blocks. A pair that meets in several large
    buckets counts in the first of them."""
    parts, (first, second) = own["part"].to_numpy(), (own["i"].iloc[0], own["j"].iloc[0])
    sets = [np.frombuffer(g, np.uint64) for g in own["grams"]]
    ids, copies = own["set_id"].tolist(), own["copies"].to_numpy(np.int64)
    # Bands that lie in large buckets before this one; others get a number no other row has.
    bands = np.array(own["bands"].tolist(), np.int64)
    large = np.array(own["large"].tolist(), bool)
    place = int(own["band"].iloc[0])
    left, right = np.flatnonzero(parts == first), np.flatnonzero(parts == second)
    sizes = np.array([len(s) for s in sets])
    counts, forest, links = np.zeros(len(own), np.int64), _Forest(len(own)), []
    for a0 in range(0, len(left), TILE):
        a = left[a0 : a0 + TILE]
        for b0 in range(a0 if first == second else 0, len(right), TILE):
            b = right[b0 : b0 + TILE]
            both = _shared([sets[x] for x in a], [sets[x] for x in b])
            close = both >= threshold * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-6
            if first == second and a0 == b0:
                close = np.triu(close, 1)
            for band in range(place):
                close &= ~((bands[a, band][:, None] == bands[b, band][None, :]) & large[a, band][:, None])
            x, y = np.nonzero(close)
            np.add.at(counts, a[x], copies[b[y]])
            np.add.at(counts, b[y], copies[a[x]])
            links.extend((ids[p], ids[q]) for p, q in zip(a[x].tolist(), b[y].tolist(), strict=True) if forest.join(p, q))
    linked = np.flatnonzero(counts)
    return pd.DataFrame(
        [(ids[x], None, int(counts[x])) for x in linked] + [(p, q, 0) for p, q in links], columns=["a", "b", "n"]
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links), one row per input row.

    Documents are linked when the Jaccard similarity of their word n-gram sets reaches the threshold;
    `n_links` is the number of other rows a row is linked with, equal copies included, and `class_id` the
    smallest doc_id among all rows joined by links. Words are separated by white space and compared as
    they are. Null texts and texts without words have no grams and no links; each is a class of its own
    with its own doc_id. Rows that repeat are copies of each other. Null doc_ids stay null.
    """
    return classified(docs, threshold, words, recall).select("doc_id", "class_id", "n_links")


def classified(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, row_key, has_words, class_id, n_links, first): as `near_duplicates`, and whether the row, or
    a copy with its row_key, stands for its class: the smallest doc_id does, a null one if there is no other."""
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    signed = written(_signatures(docs, words, bands, rows), "signatures")
    classes = written(
        signed.where("set_id is not null")
        .groupBy("set_id")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_key")).alias("first_row"), F.count(F.lit(1)).alias("copies"), F.min("n_bytes").alias("n_bytes"), F.first("bands").alias("bands")),
        "classes",
        files_for(signed.count(), 25_000),
    )
    meeting = classes.select("set_id", "n_bytes", F.posexplode("bands").alias("band", "key"))
    buckets = meeting.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bucket_bytes")).where("n > 1")
    live = written(meeting.join(buckets, ["key", "band"]), "meetings", files_for(classes.count(), 25_000))
    n_live = live.count()

    large = live.where(F.col("n") > SMALL).groupBy("set_id").agg(F.collect_set("band").alias("large_bands"))
    wanted = classes.join(live.select("set_id").distinct(), "set_id").join(large, "set_id", "left")
    sets = written(
        _sets(docs, wanted.select("set_id", "first_row.row_key"), words).join(
            wanted.select(
                "set_id", "copies", "bands", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.array_contains("large_bands", b), F.lit(False))).alias("large")
            ),
            "set_id",
        ),
        "sets",
        files_for(n_live, 50_000),
    )

    few = live.where(F.col("n") <= SMALL).select("key", "band", "set_id")
    pairs = (
        few.select("key", "band", F.col("set_id").alias("a"))
        .join(few.select("key", "band", F.col("set_id").alias("b")), ["key", "band"])
        .where("a < b")
        .select("a", "b")
        .distinct()
    )
    side = lambda name: sets.select(*[F.col(c).alias(f"{c}_{name}") for c in ("set_id", "grams", "copies", "bands", "large")])
    apart = ~F.exists(F.arrays_zip("bands_a", "bands_b", "large_a"), lambda x: (x["bands_a"] == x["bands_b"]) & x["large_a"])

    @F.pandas_udf("boolean")
    def verified(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), threshold) for a, b in zip(left, right, strict=True)], dtype=bool)

    met = pairs.join(side("a"), F.col("a") == F.col("set_id_a")).join(side("b"), F.col("b") == F.col("set_id_b")).where(apart)
    small_links = written(met.where(verified("grams_a", "grams_b")).select("a", "b", "copies_a", "copies_b"), "pairs", files_for(n_live, 50_000))

    parts = F.greatest(F.ceil(F.col("bucket_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    dealt = live.where(F.col("n") > SMALL).select("key", "band", "set_id", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "band", "set_id", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(sets, "set_id")
    large_links = written(
        dealt.groupBy("key", "band", "i", "j").applyInPandas(lambda own: _block_links(own, threshold), "a binary, b binary, n bigint"), "blocks"
    )

    links = small_links.select("a", "b").union(large_links.where("b is not null").select("a", "b"))
    roots = components(links)
    counts = (
        small_links.select(F.col("a").alias("set_id"), F.col("copies_b").alias("n"))
        .union(small_links.select(F.col("b").alias("set_id"), F.col("copies_a").alias("n")))
        .union(large_links.where("b is null").select(F.col("a").alias("set_id"), "n"))
        .groupBy("set_id")
        .agg(F.sum("n").alias("linked"))
    )
    rooted = classes.select("set_id", "first_row", "copies").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rooted = rooted.select("set_id", "first_row", "copies", F.coalesce("root", "set_id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_row").alias("class_row"))
    told = rooted.join(named, "root").join(counts, "set_id", "left").select("set_id", "class_row", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    has_words = F.col("set_id").isNotNull()
    return signed.select("doc_id", "row_key", "set_id").join(told, "set_id", "left").select(
        "doc_id",
        "row_key",
        has_words.alias("has_words"),
        F.when(has_words, F.col("class_row.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (~has_words | (F.col("row_key") == F.col("class_row.row_key"))).alias("first"),
    )


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
