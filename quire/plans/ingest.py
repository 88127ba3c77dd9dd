"""Sources and ids: pages, admission, address lists, names, vector checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids
from quire.functions.text import slug
from quire.operators.embedding import dim_report
from quire.plans.inputs import derive, doc_pages, doc_pages_sql
from quire.plans.registry import query
from quire.sources import admission
from quire.sources.pages import page_counts, read_pages, table

query("a1_read_pages", f"WITH {doc_pages_sql(20)} SELECT paper_id, page, text FROM pages")(lambda spark, d: doc_pages(spark, d, 20))



@query("a1_read_page_table", f"WITH {doc_pages_sql(20)} SELECT paper_id, page, text FROM pages")
def read_page_table(spark: SparkSession, d: str) -> DataFrame:
    """The same pages through a table in the shared folder."""
    from quire.plans.streams import run_folder

    path = run_folder(spark)
    doc_pages(spark, d, 20).write.parquet(path)
    return read_pages(spark, path)


@query("a1_page_counts", f"WITH {doc_pages_sql(20)} SELECT paper_id, count(*) AS page_count FROM pages GROUP BY 1")
def count_pages(spark: SparkSession, d: str) -> DataFrame:
    return page_counts(doc_pages(spark, d, 20))


FILES = {
    "file_name": "concat(p_name, ' ', p_partkey, CASE WHEN p_brand LIKE '%1%' THEN '.PDF' WHEN p_brand LIKE '%2%' THEN '.pdf' ELSE '.docx' END)",
    "size": "CAST(p_size AS BIGINT) * 2097152",
}


@query(
    "a2_admit",
    f"""WITH f AS (SELECT {", ".join(f"{e} AS {n}" for n, e in FILES.items())} FROM part)
SELECT file_name, size, CASE WHEN NOT ends_with(lower(file_name), '.pdf') THEN 'Only PDF files are supported.'
  WHEN size > 50 * 1024 * 1024 THEN 'File exceeds 50MB.' END AS reject_reason FROM f""",
)
def admit(spark: SparkSession, d: str) -> DataFrame:
    return admission.admit(derive(spark, d, "part", FILES))


@query(
    "a3_parse_url_batch",
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n,]+'), lambda x: trim(x)), lambda x: x <> '') AS u FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, u[i] AS url, CAST(NULL AS BIGINT) AS n_urls FROM (SELECT doc_id, u, unnest(generate_series(1, len(u))) AS i FROM l WHERE len(u) <= 25)
UNION ALL SELECT doc_id, NULL, NULL, len(u) FROM l WHERE len(u) > 25""",
)
def parse_url_batch(spark: SparkSession, d: str) -> DataFrame:
    urls, refused = admission.parse_url_batch(table(spark, d, "documents", "doc_id", "text"), "text")
    urls = urls.withColumn("position", F.col("position").cast("bigint"))
    return urls.unionByName(refused, allowMissingColumns=True)


@query(
    "a4_url_filename",
    r"""WITH n AS (SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\?.*$', '') AS f FROM pages)
SELECT page_id, CASE WHEN ends_with(lower(f), '.pdf') THEN f ELSE f || '.pdf' END AS file_name FROM n""",
)
def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url").select("page_id", admission.url_filename(F.col("url")).alias("file_name"))


@query("a13_check_dim", "SELECT count(*) AS n_points, count(*) FILTER (len(embedding) <> 64) AS n_wrong, CAST(64 AS BIGINT) AS expected_dim FROM embeddings")
def check_dim(spark: SparkSession, d: str) -> DataFrame:
    return dim_report(table(spark, d, "embeddings", "embedding"), 64)


@query(
    "a14_uuid5",
    """WITH k AS (SELECT DISTINCT l_orderkey AS paper_id, CAST(l_linenumber AS BIGINT) AS chunk_index FROM lineitem),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(paper_id || ':' || chunk_index)) AS c,
  sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(paper_id || ':table:' || chunk_index)) AS t FROM k)
SELECT paper_id, chunk_index,
  concat_ws('-', c[1:8], c[9:12], '5' || c[14:16], substr('89ab', (('0x' || c[17:17])::INT & 3) + 1, 1) || c[18:20], c[21:32]) AS chunk_id,
  concat_ws('-', t[1:8], t[9:12], '5' || t[14:16], substr('89ab', (('0x' || t[17:17])::INT & 3) + 1, 1) || t[18:20], t[21:32]) AS table_id FROM h""",
)
def uuid5(spark: SparkSession, d: str) -> DataFrame:
    keys = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "chunk_index": "CAST(l_linenumber AS BIGINT)"}).distinct()
    return keys.withColumns(
        {"chunk_id": ids.chunk_id(F.col("paper_id"), F.col("chunk_index")), "table_id": ids.table_id(F.col("paper_id"), F.col("chunk_index"))}
    )


@query(
    "a15_export_slug",
    "WITH s AS (SELECT doc_id, trim(left(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), 60), '_') AS s FROM documents) "
    "SELECT doc_id, CASE WHEN s = '' THEN 'paper' ELSE s END || '_repro_scorecard.md' AS file_name FROM s",
)
def export_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.concat(slug(F.col("text")), F.lit("_repro_scorecard.md")).alias("file_name")
    )
