"""From raw documents to packed token sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language, mixing, ngram_join, packing, suffix_dedup
from quire.llm.shared import written


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _bundled(docs: DataFrame) -> DataFrame:
    """The columns of documents, and all others in one, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in CORE]
    return docs.select(*CORE, *([F.struct(*rest).alias("_rest")] if rest else []))


def _spread(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in CORE else F.col("_rest").getField(c).alias(c) for c in names])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those whose text is null or has no letter go, and no others.

    If no label can be learnt from, or one is `und` itself, the letters of the text alone decide.
    """
    profiles = language.learn(docs.where(~language.held_out()))
    if not profiles or language.UNKNOWN in profiles:
        return docs.where(language.has_letter("text"))
    told = _bundled(docs).withColumn("_language", language.predict("text", profiles))
    return _spread(told.where(F.col("_language.lang") != language.UNKNOWN), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group, once if its row repeats.

    A row with a null doc_id stands for its group if no other has a doc_id; without words each stays.
    """
    groups = ngram_join.classified(docs).where("first").groupBy(F.col("row_key").alias("_row")).agg(F.max("has_words").alias("_words"))
    found = _bundled(docs).withColumn("_row", ngram_join.row_key()).join(groups, "_row")
    # Rows without name and words are not copies of each other.
    told = found.withColumn("_apart", F.when(F.col("doc_id").isNull() & ~F.col("_words"), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return _spread(told.dropDuplicates(["_row", "doc_id", "text", "_apart"]), docs.columns)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier document or place has; rows all stay."""
    found = suffix_dedup.with_spans(_bundled(docs))
    cut = found.withColumn("text", suffix_dedup.removed("text", "_spans"))
    return _spread(cut.withColumn("n_chars", F.length("text").cast("bigint")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by the weight of their source, in shuffled order."""
    return _spread(mixing.mix(_bundled(docs)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that was repeated is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_join", keep_one_of_each_group),
    ("suffix_dedup", remove_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the first, third and last stage cannot be written in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; gives the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
