"""The flagship: index documents, search every benchmark question, pack and cite the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import context, search
from quire.operators.chunking import chunk_papers
from quire.operators.embedding import hash_embed
from quire.plans.inputs import buckets_sql, cosine_sql, doc_pages, doc_pages_sql
from quire.plans.reading import LABELLED_SQL
from quire.plans.registry import query
from quire.sources.pages import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), "text", hash_embed(F.col("text")).alias("embedding")
    )


def indexed_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk_papers(doc_pages(spark, d, 20))
    name = F.concat(F.lit("Paper "), F.col("paper_id").cast("string"))
    return chunks.withColumns({"paper_name": name, "embedding": hash_embed(F.col("text"))})


_SQL = f"""WITH {doc_pages_sql(20)}, {LABELLED_SQL},
cv AS (SELECT *, {buckets_sql("text")} AS b FROM labelled), qs AS (SELECT item_id AS query_id, {buckets_sql("text")} AS q FROM benchmark),
best AS (SELECT query_id, cv.*, {cosine_sql("b", "q")} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id, chunk_index) AS rank FROM cv, qs QUALIFY rank <= 5),
cost AS (SELECT *, CAST(ceil(length(concat('[', rank, '] Paper ', paper_id, ' | page ', page, ' | ', section, chr(10), trim(text))) / 4.0) AS BIGINT) AS c FROM best),
run AS (SELECT *, sum(c) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM cost), kept AS (SELECT * FROM run WHERE rank = 1 OR total <= 1000)
SELECT query_id, rank, paper_id, paper_id || ':' || chunk_index AS chunk_id, page, section, round(score, 4) AS score,
  round(greatest(0.0, least(1.0, avg(score) OVER (PARTITION BY query_id))), 3) AS retrieval_score, md5(text) AS snippet_md5 FROM kept"""


@query("flagship_answer_contexts", _SQL)
def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    hits = search.knn(
        indexed_chunks(spark, d), questions(spark, d), payload=("paper_name", "page", "section", "text")
    ).withColumnRenamed("rank", "position")
    packed = context.pack_prefix(hits, ["query_id"], [F.col("position")], 1000)
    scored = search.with_retrieval_score(packed)
    cited = search.to_citation(scored.withColumnRenamed("ordinal", "rank"), "retrieval_score")
    return cited.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "paper_id", "chunk_id", "page", "section", "score", "retrieval_score",
        F.md5(F.encode("text_snippet", "UTF-8")).alias("snippet_md5"),
    )
