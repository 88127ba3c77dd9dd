"""Incremental indexing: new pages in, chunks and one outcome per paper out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.ids import chunk_id
from quire.operators.chunking import OVERLAP, SIZE, chunk_papers
from quire.operators.cleaning import assign_sections, clean_pages
from quire.operators.embedding import HASH_DIM, hash_embed
from quire.operators.scan import latest

NO_TEXT = "No extractable text found. Scanned/image-only PDFs are not supported."


def index_pages(pages_raw: DataFrame, size: int = SIZE, overlap: int = OVERLAP, dim: int = HASH_DIM, sections: bool = False) -> DataFrame:
    """Raw pages to embedded chunks: clean, chunk, number, embed."""
    # Behind the generator the filter reads the cleaned text; pushed before it, it would clean each page once more.
    cleaned = clean_pages(pages_raw)
    pages = cleaned.withColumn("text", F.explode_outer(F.array("text"))).filter(F.col("text") != "")
    if sections:
        pages = assign_sections(pages)
    chunks = chunk_papers(pages, size, overlap)
    return chunks.withColumns(
        {"chunk_id": chunk_id(F.col("paper_id"), F.col("chunk_index")), "embedding": hash_embed(F.col("text"), dim)}
    )


def outcomes(pages_raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per paper of a batch: completed with its counts, or failed with the reason."""
    papers = pages_raw.groupBy("paper_id").agg(F.count("*").alias("page_count"))
    counted = chunks.groupBy("paper_id").agg(F.count("*").alias("chunk_count"))
    joined = papers.join(counted, "paper_id", "left").fillna(0, ["chunk_count"])
    ok = F.col("chunk_count") > 0
    return joined.select(
        "paper_id", ok.alias("ok"), F.when(~ok, NO_TEXT).alias("error"), "page_count", "chunk_count"
    )


@dataclass
class Sink:
    """Folders of the chunk table and the outcome log, on storage every executor can reach.

    The chunk table is partitioned by batch; readers take, for each paper, the rows of its last
    good batch. A batch overwrites only its own folder, so a repeated batch changes nothing.

    Without `pages`, a paper arrives whole in one micro-batch. With it, pages are kept there and need a
    column `upload`, a number that grows with each upload of a paper: pages of one upload may then come
    in any number of batches, and each time all that have come are indexed together.
    """

    chunks: str
    outcomes: str
    pages: str | None = None

    def _arrived(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """All pages so far of the newest uploads of the papers in a batch."""
        if self.pages is None:
            return batch
        batch.write.mode("overwrite").parquet(f"{self.pages}/batch={batch_id}")
        kept = batch.sparkSession.read.parquet(self.pages).filter(F.col("batch") <= batch_id)
        kept = kept.join(batch.select("paper_id").distinct(), "paper_id", "left_semi")
        newest = kept.groupBy("paper_id").agg(F.max("upload").alias("upload"))
        own = kept.join(newest, ["paper_id", "upload"])
        return latest(own, ["paper_id", "page"], [F.desc("batch"), F.desc("text")]).select("paper_id", "page", "text")

    def write(self, batch: DataFrame, batch_id: int, **options) -> None:
        batch = self._arrived(batch, batch_id)
        chunks = index_pages(batch, **options)
        chunks.write.mode("overwrite").parquet(f"{self.chunks}/batch={batch_id}")
        written = batch.sparkSession.read.parquet(f"{self.chunks}/batch={batch_id}")
        outcomes(batch, written).write.mode("overwrite").parquet(f"{self.outcomes}/batch={batch_id}")

    def current(self, spark: SparkSession) -> DataFrame:
        """Chunks of every paper as its last good batch left them; a failed run keeps the earlier ones."""
        newest = spark.read.parquet(self.outcomes).filter("ok").groupBy("paper_id").agg(F.max("batch").alias("batch"))
        return spark.read.parquet(self.chunks).join(newest, ["paper_id", "batch"], "left_semi")

    def papers(self, spark: SparkSession) -> DataFrame:
        """The last outcome of every paper."""
        log = spark.read.parquet(self.outcomes)
        fields = [c for c in log.columns if c not in ("paper_id", "batch")]
        return log.groupBy("paper_id").agg(F.max("batch").alias("batch"), *[F.max_by(c, "batch").alias(c) for c in fields])


def index_stream(source: DataFrame, sink: Sink, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Run the index on a stream of raw pages. A later upload of a paper replaces it."""
    writer = source.writeStream.foreachBatch(lambda df, n: sink.write(df, n, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
