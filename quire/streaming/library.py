"""The index of a library: pages with their layout in; chunks, tables, papers and logs out, one commit a batch.

A failure stays where it happens: a page with a broken layout loses its tables, a malformed grid or a table
the model refuses is left out, and a paper without text or with a chunk the model refuses keeps what it had
before and is marked as failed. Each leaves a row among the dead letters or in its paper's status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.ids import chunk_id
from quire.operators import captured, geometry, grids, ledger
from quire.operators.chunking import OVERLAP, SIZE, chunk_papers
from quire.operators.cleaning import assign_sections, clean_pages
from quire.operators.embedding import HASH_DIM, hash_embed
from quire.operators.store import BUCKETS, Edit, Keyed, Store
from quire.streaming.indexing import NO_TEXT

# Columns of a page beside paper_id, page and text; each may be null, and an older source may lack them.
LAYOUT = {
    "title": "string",
    "width": "double",
    "height": "double",
    "words": "array<struct<x0:double,x1:double,top:double,text:string>>",
    "lines": "array<struct<line_no:bigint,x0:double,x1:double,top:double,bottom:double,text:string>>",
    "edges": "array<struct<seq:bigint,orientation:string,x0:double,x1:double,top:double,bottom:double>>",
    "grids": "array<struct<x0:double,top:double,x1:double,bottom:double,matrix:array<array<string>>>>",
}
BOX = ["x0", "top", "x1", "bottom"]
LETTER = ("paper_id", "page", "part", "error")


def with_layout(pages: DataFrame) -> DataFrame:
    """Pages with all layout columns, null where the source has none."""
    return pages.select("paper_id", F.col("page").cast("bigint"), "text", *[F.col(c).cast(t).alias(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in LAYOUT.items()])


def page_grids(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw grids of pages, dead letters): ruled grids with their nearest caption, then tables known by
    their rules and captions that overlap none of these.

    Pages whose words or rules have no place give a letter and no grids; so does a malformed grid.
    """
    judged = with_layout(pages).withColumn("error", F.coalesce(captured.words_error(F.col("words")), captured.edges_error(F.col("edges"))))
    whole, broken = captured.parted(judged)
    boxed = whole.select("paper_id", "page", F.inline("grids")).withColumn("error", captured.grid_error(F.col("matrix")))
    ruled, malformed = captured.parted(boxed)
    captions = geometry.caption_lines(whole.select("paper_id", "page", F.inline("lines")))
    named = geometry.nearest_caption(ruled, captions).select("paper_id", "page", *BOX, "caption", "matrix")
    dims = whole.filter("width IS NOT NULL").select("paper_id", "page", "width", "height")
    plain = geometry.booktabs_tables(
        captions, whole.select("paper_id", "page", F.inline("edges")), whole.select("paper_id", "page", F.inline("words")), dims, named.drop("matrix")
    ).select("paper_id", "page", *BOX, "caption", "matrix")
    letters = broken.select("paper_id", "page", F.lit("page").alias("part"), "error").union(malformed.select("paper_id", "page", F.lit("grid").alias("part"), "error"))
    return named.unionByName(plain), letters


class Library:
    """A store of chunks, tables and papers with logs of activity and dead letters.

    `model` maps a list of texts to (vectors of `dim` numbers, tokens used); without it words are hashed.
    Rows of a batch that cost a model's work, and its cleaned pages, are written to `stage` first and read from there.
    """

    def __init__(
        self, spark: SparkSession, root: str, id_type: str = "string", model: Callable | None = None, dim: int = HASH_DIM,
        buckets: int = BUCKETS, size: int = SIZE, overlap: int = OVERLAP,
    ) -> None:
        self.spark, self.stage, self.model, self.dim, self.size, self.overlap = spark, f"{root}/stage", model, dim, size, overlap
        paper = f"paper_id {id_type}"
        self.store = Store(
            spark,
            root,
            {
                "chunks": Keyed(f"{paper}, chunk_index bigint, chunk_id string, page bigint, section string, text string, embedding array<double>", buckets=buckets),
                "tables": Keyed(
                    f"{paper}, table_index bigint, page bigint, caption string, bbox array<double>, headers array<string>, rows array<array<string>>, "
                    "markdown string, search_text string, embedding array<double>",
                    buckets=buckets,
                ),
                "papers": Keyed(f"{paper}, title string, status string, error_message string, page_count bigint, chunk_count bigint", buckets=buckets),
            },
            {"activity": f"event_type string, description string, {paper}, created_at timestamp", "dead_letters": f"{paper}, page bigint, part string, error string"},
        )

    def _embedded(self, df: DataFrame, text: str) -> DataFrame:
        """Add embedding and error."""
        if self.model is None:
            return df.withColumns({"embedding": hash_embed(F.col(text), self.dim), "error": F.lit(None).cast("string")})
        return captured.embed_captured(df, text, self.model, self.dim).withColumn("embedding", F.col("embedding").cast("array<double>")).drop("usage_tokens")

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.stage}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def outcomes(self, pages: DataFrame, chunks: DataFrame, tables: DataFrame) -> DataFrame:
        """One row per paper of a batch: ok with its counts, or the reason why it failed."""
        papers = pages.groupBy("paper_id").agg(F.max("title").alias("title"), F.count_distinct("page").alias("page_count"))
        first = F.min(F.when(F.col("error").isNotNull(), F.struct("chunk_index", "error")))
        counted = chunks.groupBy("paper_id").agg(F.count("*").alias("chunk_count"), first.alias("_first"))
        tabled = tables.groupBy("paper_id").agg(F.count("*").alias("table_count"))
        joined = papers.join(counted, "paper_id", "left").join(tabled, "paper_id", "left").fillna(0, ["chunk_count", "table_count"])
        error = F.when(F.col("chunk_count") == 0, NO_TEXT).otherwise(F.col("_first.error"))
        title = F.coalesce("title", F.concat(F.lit("Paper "), F.col("paper_id").cast("string")))
        return joined.select("paper_id", error.isNull().alias("ok"), error.alias("error"), title.alias("title"), "page_count", "chunk_count", "table_count")

    def write(self, pages: DataFrame, batch: int, writer: str = "") -> bool:
        """Index a batch of whole papers and commit it; False if it was committed before.

        Good papers replace their chunks and tables. Failed ones keep theirs, and their paper row says why.
        """
        if batch <= self.store.manifest().writers.get(writer, -1):
            return False
        pages = with_layout(pages)
        cleaned = self._staged(clean_pages(pages.select("paper_id", "page", "text")), "pages").filter(F.col("text") != "")
        chunks = chunk_papers(assign_sections(cleaned), self.size, self.overlap).withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("chunk_index")))
        chunks = self._staged(self._embedded(chunks, "text"), "chunks")
        raw, letters = page_grids(pages)
        every = self._staged(self._embedded(grids.extract_tables(raw), "search_text"), "tables")
        tables, refused = captured.parted(every)
        outcomes = self._staged(self.outcomes(pages, chunks, tables), "outcomes")
        good = outcomes.filter("ok").select("paper_id")
        of_good = lambda df: df.join(good, "paper_id", "left_semi")

        def papers(now: DataFrame) -> DataFrame:
            fresh = outcomes.join(now.select("paper_id"), "paper_id", "left_anti").select("paper_id", "title", F.lit("indexing").alias("status"))
            return ledger.apply_index_outcome(now.unionByName(fresh, allowMissingColumns=True), outcomes)

        edits = {
            "chunks": Edit(good, lambda now: ledger.replace_group(now, of_good(chunks), groups=good)),
            "tables": Edit(good, lambda now: ledger.replace_group(now, of_good(tables), groups=good)),
            "papers": Edit(outcomes.select("paper_id"), papers),
        }
        part = lambda df, name: df.filter(F.col("error").isNotNull()).select("paper_id", "page", F.lit(name).alias("part"), "error")
        logs = {
            "activity": ledger.activity_of_outcomes(outcomes.withColumn("created_at", F.current_timestamp())),
            "dead_letters": letters.union(part(chunks, "chunk")).union(part(refused, "table")),
        }
        return self.store.apply(batch, edits, logs, writer)


def library_stream(source: DataFrame, library: Library, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a library up to date with a stream of pages; a paper arrives whole in one micro-batch. The
    checkpoint names the writer, so a batch that is repeated after a crash is committed once."""
    writer = source.writeStream.foreachBatch(lambda df, n: library.write(df, n, checkpoint) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
