"""Incremental indexing and answer events, run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.inputs import derive, doc_pages, doc_pages_sql
from quire.plans.reading import NORMAL, chunks_sql, dropped_sql, edges_sql
from quire.plans.registry import query
from quire.session import new_folder
from quire.sources.pages import wide_table
from quire.streaming import events as E
from quire.streaming.indexing import NO_TEXT, Sink, index_pages, index_stream
from quire.streaming.library import LAYOUT, Library, library_stream


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for one run."""
    return new_folder(spark, "run")


# Tokens of answers: the words of assistant turns between a meta and a done event.
def answer_events(spark: SparkSession, d: str) -> DataFrame:
    turns = derive(spark, d, "conversations", {"answer_id": "concat(conv_id, ':', turn)", "text": "text"})
    words = F.split("text", r"(?<= )")
    body = F.transform(words, lambda w, i: F.struct((i + 1).cast("bigint").alias("seq"), F.lit("token").alias("type"), w.alias("text")))
    mark = lambda at, kind: F.array(F.struct(at.cast("bigint").alias("seq"), F.lit(kind).alias("type"), F.lit("").alias("text")))
    every = F.concat(mark(F.lit(0), "meta"), body, mark(F.size(words) + 1, "done"))
    return turns.select("answer_id", F.explode(every).alias("e")).select("answer_id", "e.seq", "e.type", "e.text")


ANSWERS_SQL = "SELECT conv_id || ':' || turn AS answer_id, trim(text) AS answer, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens{0} FROM conversations"


@query("s3_assemble_events", ANSWERS_SQL.format(", true AS done"))
def assemble_events(spark: SparkSession, d: str) -> DataFrame:
    return E.assemble_events(answer_events(spark, d))


@query("s3_assemble_stream", ANSWERS_SQL.format(""))
def assemble_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful form over a file stream of the same events."""
    folder = run_folder(spark)
    answer_events(spark, d).write.parquet(f"{folder}/events")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/events").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/events")
    made = E.assemble_stream(source).writeStream.format("parquet").option("path", f"{folder}/answers")
    with E.listed_state(spark):
        run = made.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/answers")


def uploads(pages: DataFrame, path: str) -> DataFrame:
    """Pages as a stream of files, each paper in one file; files follow the input's size, and so do batches."""
    pages.repartition("paper_id").write.parquet(path)
    return pages.sparkSession.readStream.schema(pages.schema).option("maxBytesPerTrigger", str(1 << 30)).parquet(path)


@query(
    "s1_index_stream",
    f"""WITH {doc_pages_sql(20)}, {edges_sql("SELECT paper_id, page, text FROM pages", "greatest(3, n // 2)")}, dropped AS ({dropped_sql()}),
cleaned AS (SELECT * FROM (SELECT paper_id, page, {NORMAL} AS text FROM dropped) WHERE text <> ''), {chunks_sql(source="cleaned")}
SELECT paper_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ch GROUP BY 1""",
)
def index_stream_query(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive as files of pages; every micro-batch is indexed and replaces its papers."""
    folder = run_folder(spark)
    pages = doc_pages(spark, d, 20)
    source = uploads(pages, f"{folder}/pages")
    sink = Sink(f"{folder}/chunks", f"{folder}/outcomes")
    index_stream(source, sink, f"{folder}/state").awaitTermination()
    return sink.current(spark).groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "s2_index_outcomes",
    f"""WITH {doc_pages_sql(20)} SELECT paper_id, count(*) AS page_count, max(length(text)) > 12 AS ok,
  CASE WHEN max(length(text)) <= 12 THEN 'No extractable text found. Scanned/image-only PDFs are not supported.' END AS error FROM pages GROUP BY 1""",
)
def index_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome per paper of one batch; papers without text fail and do not stop the others."""
    from quire.streaming.indexing import outcomes

    pages = doc_pages(spark, d, 20).withColumn("text", F.when(F.length("text") > 12, F.col("text")).otherwise("7"))
    return outcomes(pages, index_pages(pages)).select("paper_id", "page_count", "ok", "error")


# Pages of documents with the layout of a small table of the document's facts on the first page. A page whose
# length divides by 7 has a word without a place, and the grid of a number of characters that divides by 5 has
# a null row.
POISON = "All rights reserved"


def library_pages(spark: SparkSession, d: str, faults: bool) -> DataFrame:
    facts = wide_table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").withColumnRenamed("doc_id", "paper_id")
    pages = doc_pages(spark, d, 20).join(facts, "paper_id")
    head, row = F.array(F.lit("Source"), F.lit("Characters")), F.array(F.coalesce("source", F.lit("")), F.col("n_chars").cast("string"))
    hole = F.when(F.lit(faults) & (F.col("n_chars") % 5 == 0), F.lit(None).cast("array<string>")).otherwise(row)
    grid = F.struct(F.lit(72.0).alias("x0"), F.lit(100.0).alias("top"), F.lit(400.0).alias("x1"), F.lit(200.0).alias("bottom"), F.array(head, row, hole).alias("matrix"))
    word = F.struct(F.lit(72.0).alias("x0"), F.lit(90.0).alias("x1"), F.when(~(F.lit(faults) & (F.length("text") % 7 == 0)), F.lit(50.0)).alias("top"), F.lit("word").alias("text"))
    return pages.select(
        "paper_id", F.col("page").cast("bigint").alias("page"), "text", F.concat(F.lit("From "), "source").alias("title"),
        F.array(word).cast(LAYOUT["words"]).alias("words"), F.when(F.col("page") == 1, F.array(grid)).cast(LAYOUT["grids"]).alias("grids"),
    )


LIBRARY_SQL = f"""{doc_pages_sql(20)}, {edges_sql("SELECT paper_id, page, text FROM pages", "greatest(3, n // 2)")}, dropped AS ({dropped_sql()}),
cleaned AS (SELECT * FROM (SELECT paper_id, page, {NORMAL} AS text FROM dropped) WHERE text <> ''), {chunks_sql(source="cleaned")},
facts AS (SELECT doc_id AS paper_id, coalesce('From ' || source, 'Paper ' || doc_id) AS title, n_chars FROM documents),
sized AS (SELECT paper_id, count(*) AS page_count FROM pages GROUP BY 1),
chunked AS (SELECT paper_id, count(*) AS n, count(CASE WHEN strpos(text, '{POISON}') > 0 THEN 1 END) AS bad, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ch GROUP BY 1)"""


@query(
    "s1_index_library",
    f"""WITH {LIBRARY_SQL}
SELECT paper_id, 'completed' AS status, left(title, 300) AS title, page_count, n AS chunk_count, n AS n_chunks, chunked.n_chars AS n_chars, CAST(1 AS BIGINT) AS n_tables, CAST(1 AS BIGINT) AS n_activity
FROM sized JOIN facts USING (paper_id) JOIN chunked USING (paper_id)
UNION ALL SELECT paper_id, 'failed', left(title, 300), NULL, NULL, 0, 0, 0, 0 FROM sized JOIN facts USING (paper_id) WHERE paper_id NOT IN (SELECT paper_id FROM chunked)""",
)
def index_library(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tables through the stream: chunks, tables, papers and activity under one commit a batch."""
    folder = run_folder(spark)
    library = Library(spark, f"{folder}/library", "bigint")
    library_stream(uploads(library_pages(spark, d, False), f"{folder}/pages"), library, f"{folder}/state").awaitTermination()
    read = library.store.read
    chunks = read("chunks").groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))
    tables = read("tables").groupBy("paper_id").agg(F.count("*").alias("n_tables"))
    activity = read("activity").groupBy("paper_id").agg(F.count("*").alias("n_activity"))
    joined = read("papers").join(chunks, "paper_id", "left").join(tables, "paper_id", "left").join(activity, "paper_id", "left")
    counts = ["n_chunks", "n_chars", "n_tables", "n_activity"]
    return joined.fillna(0, counts).select("paper_id", "status", F.col("title"), "page_count", "chunk_count", *counts)


def _refuses(texts):
    """A model for the query below: three numbers a text, and no answer to some texts."""
    if any(POISON in t for t in texts):
        raise ValueError("text refused")
    return [[1.0, float(len(t)), 0.5] for t in texts], len(texts)


@query(
    "s2_captured_failures",
    f"""WITH {LIBRARY_SQL},
lost AS (SELECT paper_id, count(CASE WHEN length(text) % 7 = 0 THEN 1 END) AS n_pages, count(CASE WHEN page = 1 AND length(text) % 7 = 0 THEN 1 END) AS first_lost FROM pages GROUP BY 1),
told AS (SELECT paper_id, page_count, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, n_pages, first_lost = 0 AS read_first, facts.n_chars % 5 = 0 AS holed,
  CASE WHEN n IS NULL THEN '{NO_TEXT}' WHEN bad > 0 THEN 'ValueError: text refused' END AS error FROM sized JOIN facts USING (paper_id) JOIN lost USING (paper_id) LEFT JOIN chunked USING (paper_id))
SELECT paper_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error AS error_message, CASE WHEN error IS NULL THEN n ELSE 0 END AS n_chunks,
  CAST(CASE WHEN error IS NULL AND read_first AND NOT holed THEN 1 ELSE 0 END AS BIGINT) AS n_tables, n_pages AS lost_pages, CAST(CASE WHEN read_first AND holed THEN 1 ELSE 0 END AS BIGINT) AS lost_grids, bad AS lost_chunks FROM told""",
)
def captured_failures(spark: SparkSession, d: str) -> DataFrame:
    """A batch with broken pages, malformed grids and texts that the model refuses: each stays by itself."""
    folder = run_folder(spark)
    library = Library(spark, folder, "bigint", model=_refuses, dim=3)
    library.write(library_pages(spark, d, True), 0)
    read = library.store.read
    chunks = read("chunks").groupBy("paper_id").agg(F.count("*").alias("n_chunks"))
    tables = read("tables").groupBy("paper_id").agg(F.count("*").alias("n_tables"))
    of = lambda part: F.count_if(F.col("part") == part)
    letters = read("dead_letters").groupBy("paper_id").agg(of("page").alias("lost_pages"), of("grid").alias("lost_grids"), of("chunk").alias("lost_chunks"))
    joined = read("papers").join(chunks, "paper_id", "left").join(tables, "paper_id", "left").join(letters, "paper_id", "left")
    counts = ["n_chunks", "n_tables", "lost_pages", "lost_grids", "lost_chunks"]
    return joined.fillna(0, counts).select("paper_id", "status", "error_message", *counts)
