"""Embedding, top-k, routing, hit shaping, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import embedding as E
from quire.operators import search
from quire.plans.inputs import buckets_sql, cosine_sql, derive
from quire.plans.registry import query
from quire.sources.pages import table, wide_table


def vowels(texts):
    """A stand-in for a model: (length, number of e, number of a)."""
    return [(float(len(t)), float(t.count("e")), float(t.count("a"))) for t in texts], sum(-(-len(t) // 4) for t in texts)


@query(
    "d1_embed",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS v0, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v1,
  CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS v2 FROM documents""",
)
def embed(spark: SparkSession, d: str) -> DataFrame:
    docs = E.embed(wide_table(spark, d, "documents", "doc_id", "text"), "text", vowels)
    return docs.select("doc_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])


@query("d1_embed_usage", "SELECT CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS usage_tokens, count(*) AS n_texts FROM documents")
def embed_usage(spark: SparkSession, d: str) -> DataFrame:
    return E.total_usage(E.embed(wide_table(spark, d, "documents", "doc_id", "text"), "text", vowels))


@query(
    "d2_hash_embed",
    f"""WITH h AS (SELECT doc_id, list_sort({buckets_sql("text")}) AS b FROM documents)
SELECT doc_id, len(b) AS n_buckets, array_to_string(b, ',') AS buckets, round(CASE WHEN len(b) > 0 THEN 1.0 / sqrt(len(b)) ELSE 0 END, 9) AS unit, CAST(256 AS BIGINT) AS dim FROM h""",
)
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    docs = wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", E.hash_embed(F.col("text")).alias("v"))
    on = F.filter(F.transform("v", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return docs.select(
        "doc_id", F.size(on).cast("bigint").alias("n_buckets"), F.array_join(on.cast("array<string>"), ",").alias("buckets"),
        F.round(F.array_max("v"), 9).alias("unit"), F.size("v").cast("bigint").alias("dim"),
    )


# Vectors of a label are the chunks of one paper; the first vector of each label is a query.
POINT = {"paper_id": "CAST(label AS BIGINT)", "chunk_index": "vec_id", "embedding": "embedding"}


def points(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "embeddings", POINT)


def first_vectors(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy(F.col("paper_id").alias("query_id")).agg(F.min_by("embedding", "chunk_index").alias("embedding"))


POINTS_SQL = """pts AS (SELECT CAST(label AS BIGINT) AS paper_id, vec_id AS chunk_index, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
qs AS (SELECT paper_id AS query_id, arg_min(e, chunk_index) AS q FROM pts GROUP BY 1)"""


def top_sql(where: str = "true", k: int = 5, source: str = "pts", index: str = "chunk_index") -> str:
    return f"""SELECT query_id, paper_id, {index}, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id, {index}) AS INT) AS rank
  FROM (SELECT query_id, paper_id, {index}, round(list_cosine_similarity(e, q), 9) AS score FROM qs, {source} WHERE {where})) WHERE rank <= {k}"""


@query("d3_knn_topk", f"WITH {POINTS_SQL} {top_sql()}")
def knn(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(points(spark, d), first_vectors(spark, d))


@query("d3_knn_min_score", f"WITH {POINTS_SQL} SELECT * FROM ({top_sql(k=50)}) WHERE score >= 0.2")
def knn_min_score(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(points(spark, d), first_vectors(spark, d), k=50, min_score=0.2)


@query(
    "d3_knn_per_paper",
    f"""WITH {POINTS_SQL} SELECT * FROM (SELECT query_id, paper_id, chunk_index, score, CAST(row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, chunk_index) AS INT) AS rank
  FROM (SELECT query_id, paper_id, chunk_index, round(list_cosine_similarity(e, q), 9) AS score FROM qs, pts)) WHERE rank <= 3""",
)
def knn_per_paper(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(points(spark, d), first_vectors(spark, d), k=3, per_paper=True)


PART_TABLE_SQL = f"""tb AS (SELECT p_brand AS paper_id, p_partkey AS table_index, {buckets_sql("concat('Table of ', p_name, ' in ', p_type, ' size')")} AS e FROM part),
qs AS (SELECT DISTINCT p_name || ' or ' || p_type AS query_id, {buckets_sql("p_name || ' or ' || p_type")} AS q FROM part)"""


def part_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "part", {"paper_id": "p_brand", "table_index": "p_partkey", "t": "concat('Table of ', p_name, ' in ', p_type, ' size')"})
    return rows.withColumn("embedding", E.hash_embed(F.col("t")))


@query(
    "d4_knn_tables",
    f"""WITH {PART_TABLE_SQL}, s AS (SELECT query_id, paper_id, table_index, {cosine_sql("e", "q")} AS score FROM qs, tb)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id, table_index) AS INT) AS rank FROM s) WHERE rank <= 2""",
)
def knn_tables(spark: SparkSession, d: str) -> DataFrame:
    asked = derive(spark, d, "part", {"query_id": "concat(p_name, ' or ', p_type)"}).distinct().withColumn("embedding", E.hash_embed(F.col("query_id")))
    return search.knn(part_tables(spark, d), asked, search.TOP_K_TABLES, keys=("paper_id", "table_index"))


@query("d5_paper_filter", f"WITH {POINTS_SQL} {top_sql('query_id = paper_id OR paper_id = query_id + 1')}")
def paper_filter(spark: SparkSession, d: str) -> DataFrame:
    own = first_vectors(spark, d).withColumn("paper_ids", F.array("query_id", F.col("query_id") + 1))
    return search.knn(points(spark, d), own)


ASKED = {"conv_id": "conv_id", "turn": "turn", "question": "concat(text, CASE role WHEN 'user' THEN ' What ACCURACY?' WHEN 'system' THEN ' in %' ELSE '' END)"}
WORDS = "|".join(r"\b" + w if w[0].isalnum() else w for w in search.TABULAR_WORDS)


@query(
    "d6_needs_tables",
    f"WITH q AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ASKED.items())} FROM conversations) "
    rf"SELECT conv_id, turn, regexp_matches(lower(question), '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(w for w in search.TABULAR_WORDS if w != '%')})|%|\d') AS needs_tables FROM q",
)
def needs_tables(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "conversations", ASKED).select("conv_id", "turn", search.needs_tables(F.col("question")).alias("needs_tables"))


MULTI_SQL = f"""{POINTS_SQL}, tb AS (SELECT paper_id, chunk_index AS table_index, list_reverse(e) AS e FROM pts),
txt AS ({top_sql()}), txt3 AS ({top_sql(k=3)}), tab AS ({top_sql("query_id > 4", 2, "tb", "table_index")}), tab4 AS ({top_sql("true", 4, "tb", "table_index")})"""


def multimodal(spark: SparkSession, d: str, table_mode: bool | None) -> DataFrame:
    ask = F.when(F.col("query_id") > 4, "compare the results").otherwise("what is the main idea")
    questions = first_vectors(spark, d).withColumn("text", ask)
    tables = points(spark, d).select(
        "paper_id", F.col("chunk_index").alias("table_index"), F.reverse("embedding").alias("embedding"),
        F.lit("| a |").alias("markdown"), F.lit("").alias("caption"),
    )
    options = {"text_payload": (), "table_payload": ("caption", "markdown")}
    if table_mode is None:
        return search.retrieve_multimodal(questions, points(spark, d), tables, **options)
    return search.retrieve(questions, points(spark, d), tables, table_mode, **options)


@query(
    "d7_retrieve_multimodal",
    f"""WITH {MULTI_SQL} SELECT query_id, 'text' AS kind, rank, paper_id, chunk_index, score, NULL AS section FROM txt
UNION ALL SELECT query_id, 'table', rank, paper_id, -table_index, score, concat('Table ', table_index) FROM tab""",
)
def retrieve_multimodal(spark: SparkSession, d: str) -> DataFrame:
    return multimodal(spark, d, None).select("query_id", "kind", "rank", "paper_id", "chunk_index", "score", "section")


ORDERED = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, rank) AS BIGINT) AS position, paper_id, chunk_index FROM
  (SELECT query_id, {0} AS s, rank, paper_id, chunk_index FROM {1} UNION ALL SELECT query_id, {2}, rank, paper_id, -table_index FROM {3})"""


@query("d8_order_hits", f"WITH {MULTI_SQL} {ORDERED.format(0, 'txt', 1, 'tab')}")
def order_hits(spark: SparkSession, d: str) -> DataFrame:
    return multimodal(spark, d, False).select("query_id", F.col("position").cast("bigint").alias("position"), "paper_id", "chunk_index")


@query("d8_order_hits_table_mode", f"WITH {MULTI_SQL} {ORDERED.format(1, 'txt3', 0, 'tab4')}")
def order_hits_table_mode(spark: SparkSession, d: str) -> DataFrame:
    return multimodal(spark, d, True).select("query_id", F.col("position").cast("bigint").alias("position"), "paper_id", "chunk_index")


@query(
    "d9_table_hit_to_chunk",
    r"""WITH h AS (SELECT doc_id AS table_index, source AS paper_id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS caption, text, left(text, 6000) AS t FROM documents)
SELECT paper_id, table_index, 'table' AS kind, coalesce(nullif(caption, ''), concat('Table ', table_index)) AS section, -table_index AS chunk_index,
  CASE WHEN length(text) <= 6000 THEN text WHEN contains(t, chr(10)) THEN left(t, length(t) - length(regexp_extract(t, '[^\n]*$')) - 1) || chr(10) || '| ... |' ELSE t || chr(10) || '| ... |' END AS text FROM h""",
)
def table_hit_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    hits = derive(
        spark, d, "documents",
        {"paper_id": "source", "table_index": "doc_id", "caption": "CASE WHEN lang = 'en' THEN '' ELSE lang END", "markdown": "text"},
    )
    return search.table_hit_to_chunk(hits)


@query(
    "d10_retrieval_score",
    f"WITH {POINTS_SQL}, t AS ({top_sql()}) SELECT query_id, round(greatest(0.0, least(1.0, avg(score))), 3) AS retrieval_score FROM t GROUP BY 1",
)
def retrieval_score(spark: SparkSession, d: str) -> DataFrame:
    return search.retrieval_score(search.knn(points(spark, d), first_vectors(spark, d)))


@query(
    "d11_to_citation",
    f"""WITH {POINTS_SQL}, t AS ({top_sql()}) SELECT query_id, rank, paper_id, concat('Label ', paper_id) AS paper_name, chunk_index + 1 AS page, 'S' AS section,
  concat(paper_id, ':', chunk_index) AS chunk_id, concat('Text ', chunk_index) AS text_snippet, round(score, 4) AS score, 'text' AS kind, CAST(NULL AS BIGINT) AS table_index FROM t""",
)
def to_citation(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).selectExpr("*", "concat('Label ', paper_id) AS paper_name", "chunk_index + 1 AS page", "'S' AS section", "concat('Text ', chunk_index) AS text")
    return search.to_citation(search.knn(rows, first_vectors(spark, d), payload=("paper_name", "page", "section", "text")))


@query(
    "d12_paper_scan",
    "SELECT CAST(label AS BIGINT) AS paper_id, vec_id AS chunk_index FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 50)",
)
def paper_scan(spark: SparkSession, d: str) -> DataFrame:
    big = points(spark, d).groupBy("paper_id").count().filter("count >= 50")
    return search.paper_chunks(points(spark, d), big)


@query("d13_collection_info", "SELECT count(*) AS points_count, max(len(embedding)) AS vector_size, 'Cosine' AS distance FROM embeddings")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return search.collection_info(points(spark, d))
