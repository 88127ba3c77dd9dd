"""Which files and addresses are let in, and under which name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
MAX_BATCH = 25
SUFFIX = ".pdf"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes; file content is never read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size")
    )


def admit(files: DataFrame, suffix: str = SUFFIX, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add `reject_reason`: null for accepted files."""
    reason = (
        F.when(~F.endswith(F.lower(F.coalesce("file_name", F.lit(""))), F.lit(suffix)), "Only PDF files are supported.")
        .when(F.col("size") > max_bytes, f"File exceeds {max_bytes // (1024 * 1024)}MB.")
    )
    return files.withColumn("reject_reason", reason)


def accepted(files: DataFrame) -> DataFrame:
    return files.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(files: DataFrame) -> DataFrame:
    return files.filter(F.col("reject_reason").isNotNull())


def url_list(c: Column) -> Column:
    """Entries of a pasted list: newline or comma separated, trimmed, without blanks."""
    entries = F.transform(F.split(c, r"[\n,]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    return F.filter(entries, lambda x: x != "")


def parse_url_batch(df: DataFrame, column: str, max_urls: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """(one row per URL with its position, batches refused for their size)."""
    listed = df.withColumn("_urls", url_list(F.col(column)))
    taken = listed.filter(F.size("_urls") <= max_urls)
    urls = taken.select(*[c for c in df.columns if c != column], F.posexplode("_urls").alias("position", "url"))
    refused = listed.filter(F.size("_urls") > max_urls).withColumn("n_urls", F.size("_urls").cast("bigint")).drop("_urls", column)
    return urls, refused


def url_filename(url: Column, given: Column | None = None, suffix: str = SUFFIX) -> Column:
    """Last path segment without its query; a given name wins; the suffix is made sure of."""
    name = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    if given is not None:
        name = F.coalesce(F.when(given != "", given), name)
    return F.when(F.endswith(F.lower(name), F.lit(suffix)), name).otherwise(F.concat(name, F.lit(suffix)))
