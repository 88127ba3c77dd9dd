"""Page sources. A page is one row: paper_id, page (from 1), text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.bind import let
from quire.functions.text import lines_of
from quire.session import spread

FORM_FEED = "\f"


def paginate_text(text: Column, lines_per_page: int) -> Column:
    """Array of pages of a fixed number of lines."""

    def cut(lines: Column) -> Column:
        last = F.ceil(F.size(lines) / lines_per_page).cast("int") - 1
        pages = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, F.lit(lines_per_page)), "\n"),
        )
        return F.when(last < 0, F.array().cast("array<string>")).otherwise(pages)

    return let(lines_of(text), cut)


def pages_from_text(df: DataFrame, paper: str, text: str = "text", lines_per_page: int | None = None) -> DataFrame:
    """Split whole texts into pages, at form feeds or every `lines_per_page` lines."""
    parts = F.split(F.col(text), FORM_FEED) if lines_per_page is None else paginate_text(F.col(text), lines_per_page)
    rows = df.select(F.col(paper).alias("paper_id"), F.posexplode(parts).alias("_at", "text"))
    return rows.select("paper_id", (F.col("_at") + 1).cast("bigint").alias("page"), "text")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages from a table with paper_id, page, text; or from text files, one paper per file."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("paper_id"), F.col("value").alias("text"))
        return pages_from_text(files, "paper_id")
    return spark.read.format(fmt).load(path).select("paper_id", F.col("page").cast("bigint").alias("page"), "text")


def page_counts(pages: DataFrame) -> DataFrame:
    """Number of pages of each paper."""
    return pages.groupBy("paper_id").agg(F.count("*").alias("page_count"))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a folder, with only the columns asked for."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def wide_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Like `table`, for CPU-heavy row work: small inputs are spread over the cores."""
    return spread(table(spark, folder, name, *columns))
