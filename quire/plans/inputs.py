"""Corpora derived from the given tables, and the same derivations as SQL for the oracles.

Expressions that both engines understand are written once, as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.embedding import hash_embed
from quire.sources.pages import pages_from_text, table, wide_table


def doc_pages(spark: SparkSession, d: str, lines: int) -> DataFrame:
    """Each document is a paper; a page is a block of its lines."""
    return pages_from_text(wide_table(spark, d, "documents", "doc_id", "text"), "doc_id", lines_per_page=lines)


def doc_pages_sql(lines: int) -> str:
    return f"""ls AS (SELECT doc_id AS paper_id, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT paper_id, p AS page, array_to_string(ls[(p-1)*{lines}+1 : p*{lines}], chr(10)) AS text
  FROM (SELECT paper_id, ls, unnest(generate_series(1, CAST(ceil(len(ls)/{lines}.0) AS BIGINT))) AS p FROM ls))"""


def doc_chunks(spark: SparkSession, d: str, lines: int) -> DataFrame:
    """Pages of documents in the role of chunks, numbered from 0, with vectors."""
    return doc_pages(spark, d, lines).select(
        "paper_id", (F.col("page") - 1).alias("chunk_index"), F.concat(F.lit("Paper "), F.col("paper_id").cast("string")).alias("paper_name"),
        "page", F.lit("Body").alias("section"), "text", hash_embed(F.col("text")).alias("embedding"),
    )


HASH_SQL = "list_distinct(list_transform(regexp_extract_all(lower({0}), '[a-z]{{3,}}'), lambda w: ('0x' || right(md5(w), 2))::INT))"


def buckets_sql(column: str) -> str:
    return HASH_SQL.format(column)


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two bucket lists."""
    return f"round(coalesce(len(list_intersect({a}, {b})) / nullif(sqrt(len({a})) * sqrt(len({b})), 0), 0), 9)"


def doc_chunks_sql(lines: int) -> str:
    return doc_pages_sql(lines) + f""",
chunks AS (SELECT paper_id, page - 1 AS chunk_index, 'Paper ' || paper_id AS paper_name, page, 'Body' AS section, text,
  {buckets_sql("text")} AS b FROM pages)"""


# Orders of a customer as the pages of one paper: running header, often a heading, two lines, a page number.
MANUSCRIPT = {
    "paper_id": "o_custkey",
    "page": "o_orderkey",
    "text": """concat_ws(chr(10), concat('Ledger of customer ', o_custkey),
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '1 Introduction' WHEN '2' THEN 'ABSTRACT'
        WHEN '3' THEN '3.2 Experimental Setup' WHEN '4' THEN concat('Plain opening line ', o_orderkey) ELSE 'IV. Results and Trans-type Notes' END,
      concat('Order ', o_orderkey, ' has status ', o_orderstatus),
      concat('worth ', CAST(round(o_totalprice * 100) AS BIGINT), ' cents.'), CAST(o_orderkey % 1000 AS STRING))""",
}


def _sql(fields: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {source}"


def derive(spark: SparkSession, d: str, source: str, fields: dict[str, str], wide: bool = False) -> DataFrame:
    """`wide` for CPU-heavy row work, as in `wide_table`."""
    return (wide_table if wide else table)(spark, d, source).selectExpr(*[f"{e} AS {n}" for n, e in fields.items()])


def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "orders", MANUSCRIPT, wide=True)


MANUSCRIPT_SQL = _sql(MANUSCRIPT, "orders")

# Orders of a customer as positioned text lines.
TEXT_LINE = {
    "paper_id": "o_custkey",
    "page": "o_orderkey % 4 + 1",
    "line_no": "o_orderkey",
    "x0": "CAST(72 AS DOUBLE)",
    "x1": "CAST(102 + (o_orderkey % 30) * 10 AS DOUBLE)",
    "top": "CAST(12 * (o_orderkey % 50) AS DOUBLE)",
    "bottom": "CAST(12 * (o_orderkey % 50) + 10 AS DOUBLE)",
    "text": """CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN concat('Table ', o_orderkey % 9 + 1, ': Order totals')
      WHEN '2' THEN 'TABLE IV' WHEN '3' THEN concat('Table 2 shows order ', o_orderkey) WHEN '4' THEN concat('Tab. ', o_orderkey % 7 + 1, '. Totals')
      ELSE concat('Plain text ', o_orderkey) END""",
}
TEXT_LINE_SQL = _sql(TEXT_LINE, "orders")


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "orders", TEXT_LINE, wide=True)


# Evidence sentences: orders of a customer are the chunks of a paper.
EVIDENCE = {
    "paper_id": "o_custkey",
    "seq": "o_orderkey",
    "text": """concat('Weights are released, see https://gitlab.com/yard', o_orderkey % 7, '/dock', o_orderkey % 3, '. Ran on two ',
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'H100' WHEN '2' THEN 'RTX 4090' WHEN '3' THEN 'P100' WHEN '4' THEN 'TPU v3' ELSE 'l40s' END,
      ' boards, ', o_orderkey % 40, ' days on end, seed ', o_custkey, '; mean of 4 trials, std. 0.7 ± 0.1, p = 0.02. ',
      CASE o_orderstatus WHEN 'F' THEN 'Contaminated rows leaked twice. Log: http://example.org/x.' WHEN 'O' THEN 'The data would be open-sourced, models will be released.'
        ELSE 'Energy consumption in kWh; JAX in a docker image.' END)""",
}
EVIDENCE_SQL = _sql(EVIDENCE, "orders")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "orders", EVIDENCE, wide=True)


# Three words per line item, laid out as a row of a grid; an order is a page.
WORD_FIELDS = {
    "top": "CAST(12 * l_linenumber AS DOUBLE) + CAST(l_partkey % 3 AS DOUBLE) * 0.75",
    "a": "concat('part', l_partkey)",
    "b": "CAST(CAST(l_quantity AS BIGINT) AS STRING)",
    "c": "concat('flag ', l_returnflag)",
}


def words(spark: SparkSession, d: str) -> DataFrame:
    base = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "page": "CAST(1 AS BIGINT)", "shift": "CAST(l_suppkey % 5 AS DOUBLE)", **WORD_FIELDS}, wide=True)
    word = lambda c, x: F.struct(
        F.lit(x) + F.col("shift") * (0.0 if c == "a" else 1.0), F.lit(x) + F.col("shift") * (0.0 if c == "a" else 1.0) + 5.0 * F.length(c), F.col(c)
    ).cast("struct<x0:double,x1:double,text:string>")
    rows = base.select("paper_id", "page", "top", F.explode(F.array(word("a", 10.0), word("b", 90.0), word("c", 150.0))).alias("w"))
    return rows.select("paper_id", "page", "w.x0", "w.x1", "top", "w.text")


WORDS_SQL = f"""base AS (SELECT l_orderkey AS paper_id, CAST(1 AS BIGINT) AS page, CAST(l_suppkey % 5 AS DOUBLE) AS shift,
  {", ".join(f"{e} AS {n}" for n, e in WORD_FIELDS.items())} FROM lineitem),
words AS (SELECT paper_id, page, 10.0::DOUBLE AS x0, 10.0::DOUBLE + 5 * length(a) AS x1, top, a AS text FROM base
  UNION ALL SELECT paper_id, page, 90.0::DOUBLE + shift, 90.0::DOUBLE + shift + 5 * length(b), top, b FROM base
  UNION ALL SELECT paper_id, page, 150.0::DOUBLE + shift, 150.0::DOUBLE + shift + 5 * length(c), top, c FROM base)"""
