"""The ledger: next states of record tables, lookups, counters, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import chunk_id, table_id
from quire.operators import ledger as L
from quire.plans.inputs import derive
from quire.plans.registry import query
from quire.session import parts
from quire.sources.pages import table

# A shuffle's partition holds so many papers, or keys of requests and cache.
PAPERS_PER_PART, KEYS_PER_PART = 100_000, 1_000_000


def select(fields: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {source}"


def filtered(spark: SparkSession, d: str, source: str, fields: dict, where: str) -> DataFrame:
    return table(spark, d, source).filter(where).selectExpr(*[f"{e} AS {n}" for n, e in fields.items()])


# Chunks of customers are orders; late line items bring new text for their order's chunk.
CHUNK = {"paper_id": "o_custkey", "chunk_index": "o_orderkey", "text": "concat('order ', o_orderpriority)"}
LATE = {"paper_id": "l_suppkey", "chunk_index": "l_orderkey", "text": "concat('part ', l_partkey)", "at": "CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey"}


@query(
    "a5_upsert_chunks",
    f"""WITH t AS ({select(CHUNK, 'orders')}), u AS ({select(LATE, 'lineitem')} QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1)
SELECT paper_id, chunk_index, text FROM t ANTI JOIN u USING (paper_id, chunk_index) UNION ALL SELECT paper_id, chunk_index, text FROM u""",
)
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    identify = lambda df: df.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("chunk_index")))
    target, late = identify(derive(spark, d, "orders", CHUNK)), identify(derive(spark, d, "lineitem", LATE))
    return L.upsert(target, late, ["chunk_id"], [F.desc("at"), F.col("text")]).drop("chunk_id")


@query(
    "a6_upsert_tables",
    """WITH t AS (SELECT p_brand AS paper_id, p_partkey AS table_index, p_name AS markdown FROM part), u AS (SELECT p_brand AS paper_id, p_partkey AS table_index, 'new ' || p_type AS markdown FROM part WHERE p_size > 25)
SELECT paper_id, table_index, markdown FROM t WHERE (paper_id, table_index) NOT IN (SELECT (paper_id, table_index) FROM u) UNION ALL SELECT * FROM u""",
)
def upsert_tables(spark: SparkSession, d: str) -> DataFrame:
    fields = {"paper_id": "p_brand", "table_index": "p_partkey"}
    identify = lambda df: df.withColumn("table_id", table_id(F.col("paper_id"), F.col("table_index")))
    target = identify(derive(spark, d, "part", {**fields, "markdown": "p_name"}))
    fresh = identify(filtered(spark, d, "part", {**fields, "markdown": "concat('new ', p_type)"}, "p_size > 25"))
    return L.upsert(target, fresh, ["table_id"]).drop("table_id")


@query(
    "a7_replace_group",
    """WITH u AS (SELECT o_orderkey AS paper_id, CAST(1 AS BIGINT) AS table_index, o_orderpriority AS caption FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey AS paper_id, CAST(l_linenumber AS BIGINT) AS table_index, concat('part ', l_partkey) AS caption FROM lineitem WHERE l_orderkey NOT IN (SELECT paper_id FROM u) UNION ALL SELECT * FROM u""",
)
def replace_group(spark: SparkSession, d: str) -> DataFrame:
    target = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "table_index": "CAST(l_linenumber AS BIGINT)", "caption": "concat('part ', l_partkey)"})
    new = filtered(spark, d, "orders", {"paper_id": "o_orderkey", "table_index": "CAST(1 AS BIGINT)", "caption": "o_orderpriority"}, "o_orderstatus = 'F'")
    return L.replace_group(target, new)


CACHE = {"paper_id": "user_id", "summary_type": "event_type", "summary_text": "concat('v', event_id)", "created_at": "ts"}


@query(
    "a8_cache_upsert",
    """WITH t AS (SELECT user_id AS paper_id, event_type AS summary_type, 'v' || min(event_id) AS summary_text FROM events GROUP BY 1, 2),
u AS (SELECT user_id AS paper_id, event_type AS summary_type, 'v' || event_id AS summary_text FROM events WHERE event_type IN ('view', 'click') AND value > 20 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM t ANTI JOIN u USING (paper_id, summary_type) UNION ALL SELECT * FROM u""",
)
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    target = derive(spark, d, "events", {**CACHE, "id": "event_id"}).groupBy("paper_id", "summary_type").agg(F.min_by("summary_text", "id").alias("summary_text"))
    updates = filtered(spark, d, "events", {**CACHE, "id": "event_id"}, "event_type IN ('view', 'click') AND value > 20")
    return L.upsert(target, updates, ["paper_id", "summary_type"], [F.desc("created_at"), F.desc("id")])


@query(
    "a9_cascade_delete",
    """WITH gone AS (SELECT o_orderkey AS paper_id FROM orders WHERE o_orderstatus = 'F')
SELECT 'papers' AS table_name, count(*) AS n_rows FROM orders WHERE o_orderkey NOT IN (SELECT paper_id FROM gone)
UNION ALL SELECT 'paper_tables', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT paper_id FROM gone)
UNION ALL SELECT 'activity', count(*) FROM events WHERE event_type = 'error' OR event_id NOT IN (SELECT paper_id FROM gone)
UNION ALL SELECT 'qa_logs', count(*) FROM conversations""",
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    state = {
        "papers": derive(spark, d, "orders", {"paper_id": "o_orderkey"}),
        "paper_tables": derive(spark, d, "lineitem", {"paper_id": "l_orderkey"}),
        "activity": derive(spark, d, "events", {"paper_id": "CASE WHEN event_type <> 'error' THEN event_id END"}),
        "qa_logs": derive(spark, d, "conversations", {"paper_id": "conv_id"}),
    }
    left = L.delete_papers(state, filtered(spark, d, "orders", {"paper_id": "o_orderkey"}, "o_orderstatus = 'F'"))
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "a10_append_logs",
    """SELECT conv_id, turn, 'qa' AS event_type, 'Asked: ' || left(text, 80) AS description, CASE WHEN turn % 3 = 0 THEN conv_id END AS paper_id FROM conversations""",
)
def append_logs(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "text AS question", "CASE turn % 3 WHEN 0 THEN array(conv_id) WHEN 1 THEN array(conv_id, turn) ELSE array() END AS paper_ids", "struct(conv_id, turn) AS created_at"
    )
    return L.activity_of_questions(qa).select("created_at.conv_id", "created_at.turn", "event_type", "description", "paper_id")


PAPER = {"paper_id": "o_orderkey", "title": "o_orderpriority", "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'indexing' ELSE 'failed' END", "page_count": "CAST(0 AS BIGINT)", "chunk_count": "CAST(0 AS BIGINT)", "error_message": "CASE WHEN o_orderstatus = 'P' THEN 'old' END"}
PAPER_SQL = f"papers AS ({select(PAPER, 'orders')})"
FACTS_SQL = "facts AS (SELECT l_orderkey AS paper_id, count(*) AS page_count, sum(CAST(l_quantity AS BIGINT))::BIGINT AS chunk_count, max(l_partkey) AS part, min(l_linestatus) AS worst FROM lineitem GROUP BY 1)"


def papers(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "orders", PAPER)


def facts(spark: SparkSession, d: str, n_parts: int | None = None) -> DataFrame:
    """`n_parts` deals the rows before they are grouped: a hash table of a whole split grows with the split."""
    rows = table(spark, d, "lineitem")
    return (rows if n_parts is None else rows.repartition(n_parts, "l_orderkey")).groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.count("*").alias("page_count"), F.sum(F.col("l_quantity").cast("bigint")).alias("chunk_count"), F.max("l_partkey").alias("part"), F.min("l_linestatus").alias("worst")
    )


@query(
    "a11_update_by_key",
    f"""WITH {PAPER_SQL}, {FACTS_SQL} SELECT p.paper_id, coalesce(left(repeat('title ' || part || ' ', 40), 300), title) AS title, status, coalesce(f.page_count, p.page_count) AS page_count, p.chunk_count, error_message
FROM papers p LEFT JOIN facts f USING (paper_id)""",
)
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    changes = facts(spark, d).selectExpr("paper_id", "repeat(concat('title ', part, ' '), 40) AS title", "page_count")
    return L.update_by_key(papers(spark, d), changes, limits={"title": L.MAX_TITLE})


OUTCOME = [
    "paper_id", "worst = 'O' AS ok", "repeat(concat('error ', part, ' '), 60) AS error", "concat('Title ', part) AS title", "page_count", "chunk_count",
]


@query(
    "a12_index_outcome",
    f"""WITH {PAPER_SQL}, {FACTS_SQL}, o AS (SELECT {', '.join(OUTCOME)} FROM facts)
SELECT p.paper_id, CASE WHEN ok THEN o.title ELSE p.title END AS title, CASE WHEN ok THEN 'completed' WHEN NOT ok THEN 'failed' ELSE status END AS status, CASE WHEN ok THEN o.page_count ELSE p.page_count END AS page_count,
  CASE WHEN ok THEN o.chunk_count ELSE p.chunk_count END AS chunk_count, CASE WHEN ok THEN NULL WHEN NOT ok THEN left(error, 500) ELSE error_message END AS error_message FROM papers p LEFT JOIN o USING (paper_id)""",
)
def index_outcome(spark: SparkSession, d: str) -> DataFrame:
    n_parts = parts(spark, table(spark, d, "orders").count(), PAPERS_PER_PART)
    return L.apply_index_outcome(papers(spark, d), facts(spark, d, n_parts).selectExpr(*OUTCOME), n_parts)


INDEXED = {"paper_id": "o_orderkey", "ok": "o_orderstatus <> 'P'", "title": "concat('Order of ', o_orderdate, ' ', repeat('x', 80))", "chunk_count": "o_orderkey % 40", "table_count": "o_custkey % 3", "created_at": "o_orderdate"}


@query(
    "a12_indexed_activity",
    f"""WITH o AS ({select(INDEXED, 'orders')}) SELECT 'indexed' AS event_type, paper_id, created_at,
  'Indexed ' || left(title, 80) || ' (' || chunk_count || ' chunks' || CASE WHEN table_count > 0 THEN ', ' || table_count || ' tables' ELSE '' END || ')' AS description FROM o WHERE ok""",
)
def indexed_activity(spark: SparkSession, d: str) -> DataFrame:
    return L.activity_of_outcomes(derive(spark, d, "orders", INDEXED))


@query("a10_upload_activity", "SELECT 'upload' AS event_type, 'Uploaded ' || p_name || '.pdf' AS description, p_partkey AS paper_id, p_size AS created_at FROM part")
def upload_activity(spark: SparkSession, d: str) -> DataFrame:
    return L.activity_of_uploads(derive(spark, d, "part", {"paper_id": "p_partkey", "file_name": "concat(p_name, '.pdf')", "created_at": "p_size"}))


@query("a10_appended_all", "SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents")
def appended_all(spark: SparkSession, d: str) -> DataFrame:
    """A log to which all its rows are added again as a second batch, which is run twice."""
    from quire.plans.streams import run_folder

    path, rows = run_folder(spark), table(spark, d, "documents", "doc_id", "source")
    for batch in (0, 1, 1):
        L.append(rows, path, batch)
    return spark.read.parquet(path).select("doc_id", "source")


@query("a12_stale_audits", f"WITH {FACTS_SQL} SELECT o_orderkey AS paper_id, o_totalprice AS score FROM orders WHERE o_orderkey NOT IN (SELECT paper_id FROM facts WHERE worst = 'O')")
def stale_audits(spark: SparkSession, d: str) -> DataFrame:
    audits = derive(spark, d, "orders", {"paper_id": "o_orderkey", "score": "o_totalprice"})
    return L.drop_stale_audits(audits, facts(spark, d).selectExpr("paper_id", "worst = 'O' AS ok"))


KIND = "CASE event_type WHEN 'view' THEN 'summary' WHEN 'click' THEN 'quiz' WHEN 'signup' THEN 'flashcards' ELSE event_type END"


@query(
    "h1_stats",
    f"""SELECT (SELECT count(*) FROM orders) AS total_papers, (SELECT count(*) FROM conversations WHERE role = 'user') AS questions_asked,
  (SELECT count(*) FROM events WHERE {KIND} = 'summary') AS summaries_generated, (SELECT count(*) FROM events WHERE {KIND} IN ('quiz', 'flashcards')) AS study_sessions""",
)
def stats(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "conversations").filter("role = 'user'")
    return L.stats(papers(spark, d), qa, derive(spark, d, "events", {"event_type": KIND}))


@query("h2_recent_activity", "SELECT event_id AS id, event_type, user_id AS paper_id, ts FROM events ORDER BY event_id DESC LIMIT 10")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return L.recent(derive(spark, d, "events", {"id": "event_id", "event_type": "event_type", "paper_id": "user_id", "ts": "ts"}), 10)


@query("h2_recent_questions", "SELECT conv_id * 100 + turn AS id, text AS question FROM conversations WHERE role = 'user' ORDER BY id DESC LIMIT 20")
def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    return L.recent(filtered(spark, d, "conversations", {"id": "conv_id * 100 + turn", "question": "text"}, "role = 'user'"), 20)


LISTED = {"paper_id": "o_orderkey", "title": "concat(o_orderpriority, ' of ', o_custkey)", "uploaded_at": "o_orderdate"}


@query("h3_list_papers", f"{select(LISTED, 'orders')} ORDER BY uploaded_at DESC, paper_id")
def list_papers(spark: SparkSession, d: str) -> DataFrame:
    return L.list_papers(derive(spark, d, "orders", LISTED))


@query("h3_list_papers_by_title", f"{select(LISTED, 'orders')} ORDER BY lower(title), title, paper_id")
def list_papers_by_title(spark: SparkSession, d: str) -> DataFrame:
    return L.list_papers(derive(spark, d, "orders", LISTED), "title")


@query("h4_search_library", f"SELECT * FROM ({select(LISTED, 'orders')}) WHERE contains(lower(title), 'medium of 1')")
def search_library(spark: SparkSession, d: str) -> DataFrame:
    return L.search_library(derive(spark, d, "orders", LISTED), "Medium of 1", ["title"])


@query("h5_point_lookup", f"{select(LISTED, 'orders')} WHERE o_orderkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return L.get(derive(spark, d, "orders", LISTED), paper_id=42)


STORED = {"paper_id": "p_brand", "table_index": "p_partkey", "page": "p_size", "caption": "p_name", "markdown": "concat('| ', p_type, ' |')"}


@query("h6_paper_tables", "SELECT p_partkey AS table_index, p_size AS page, p_name AS caption, '| ' || p_type || ' |' AS markdown, p_type || '|x' AS headers, p_name || '|' || p_size AS rows FROM part WHERE p_brand = 'Brand#2'")
def paper_tables(spark: SparkSession, d: str) -> DataFrame:
    stored = derive(spark, d, "part", {**STORED, "headers": "array(p_type, 'x')", "rows": "array(array(p_name, CAST(p_size AS STRING)))"})
    found = L.paper_tables(stored, "Brand#2")
    return found.withColumns({"headers": F.array_join("headers", "|"), "rows": F.array_join(F.flatten("rows"), "|")})


@query(
    "h7_check_ready",
    f"""WITH {PAPER_SQL}, rq AS (SELECT c_custkey AS request_id, unnest([c_custkey, c_custkey * 3, c_custkey * 11 + 5]) AS paper_id, unnest([0, 1, 2]) AS pos FROM customer),
j AS (SELECT request_id, pos, rq.paper_id, title, status, CASE WHEN p.paper_id IS NULL THEN 404 WHEN status <> 'completed' THEN 409 END AS code FROM rq LEFT JOIN papers p USING (paper_id)),
f AS (SELECT request_id, arg_min({{'c': code, 'p': j.paper_id, 't': title, 's': status}}, pos) FILTER (code IS NOT NULL) AS x FROM j GROUP BY 1)
SELECT request_id, x IS NULL AS ready, CAST(x.c AS BIGINT) AS code, CASE x.c WHEN 404 THEN 'Paper ' || x.p || ' not found.' WHEN 409 THEN '''' || x.t || ''' is still ' || x.s || '.' END AS reason FROM f""",
)
def check_ready(spark: SparkSession, d: str) -> DataFrame:
    asked = derive(spark, d, "customer", {"request_id": "c_custkey", "paper_ids": "array(c_custkey, c_custkey * 3, c_custkey * 11 + 5)"})
    return L.check_ready(asked, papers(spark, d))


ASK = {"paper_id": "o_orderkey", "summary_type": "o_orderstatus", "refresh": "o_totalprice > 300000"}


@query(
    "h8_cache_split",
    f"""WITH r AS ({select(ASK, 'orders')}), c AS (SELECT DISTINCT l_orderkey AS paper_id, CASE WHEN l_returnflag = 'A' THEN 'F' WHEN l_returnflag = 'R' THEN 'O' ELSE 'P' END AS summary_type FROM lineitem)
SELECT paper_id, summary_type, refresh, NOT refresh AND (paper_id, summary_type) IN (SELECT (paper_id, summary_type) FROM c) AS cached FROM r""",
)
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    cache = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "summary_type": "CASE WHEN l_returnflag = 'A' THEN 'F' WHEN l_returnflag = 'R' THEN 'O' ELSE 'P' END"})
    n_parts = parts(spark, table(spark, d, "orders").count() + cache.count(), KEYS_PER_PART)
    hits, misses = L.cache_split(derive(spark, d, "orders", ASK), cache, ["paper_id", "summary_type"], n_parts)
    return hits.withColumn("cached", F.lit(True)).unionByName(misses.withColumn("cached", F.lit(False)))


@query(
    "h9_qa_metrics",
    "SELECT role, count(*) AS n_answers, round(avg((turn % 10) / 10.0::DOUBLE), 6) AS mean_score, round(avg(CAST(length(text) AS DOUBLE)), 6) AS mean_latency, max(CAST(length(text) AS DOUBLE)) AS max_latency FROM conversations GROUP BY 1",
)
def qa_metrics(spark: SparkSession, d: str) -> DataFrame:
    log = derive(spark, d, "conversations", {"role": "role", "retrieval_score": "(turn % 10) / 10D", "latency_sec": "CAST(length(text) AS DOUBLE)"})
    return L.qa_metrics(log, ["role"])


REQUEST = {
    "request_id": "event_id", "kind": "CASE event_id % 6 WHEN 0 THEN 'qa' WHEN 1 THEN 'quiz' WHEN 2 THEN 'flashcards' WHEN 3 THEN 'compare' WHEN 4 THEN 'gaps' ELSE 'summary' END",
    "text": "repeat('q', CAST(floor(value * 60) AS INT))", "difficulty": "CASE user_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extreme' END", "n": "CAST(floor(value) AS INT)",
    "style": "CASE WHEN event_type = 'view' THEN 'bullet' WHEN event_type = 'click' THEN 'one-page' ELSE event_type END", "quiz_type": "CASE WHEN event_type = 'error' THEN 'essay' ELSE 'mcq' END",
}


@query(
    "h10_validate_requests",
    f"""WITH q AS ({select({**REQUEST, "np": "user_id % 3"}, "events")})
SELECT request_id, kind, CASE WHEN kind = 'qa' AND NOT length(text) BETWEEN 1 AND 2000 THEN 'question length' WHEN kind IN ('quiz', 'flashcards', 'gaps', 'summary') AND np < 1 THEN 'no paper'
  WHEN kind = 'compare' AND np < 2 THEN 'Select at least two papers to compare.' WHEN kind = 'quiz' AND quiz_type = 'essay' THEN 'unknown quiz type' WHEN kind = 'quiz' AND difficulty = 'extreme' THEN 'difficulty'
  WHEN kind = 'quiz' AND NOT n BETWEEN 1 AND 15 THEN 'number of questions' WHEN kind = 'flashcards' AND NOT n BETWEEN 1 AND 20 THEN 'number of cards' WHEN kind = 'summary' AND style NOT IN ('bullet', 'one-page') THEN 'unknown summary type' END AS reject_reason FROM q""",
)
def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "events", {**REQUEST, "paper_ids": "array_repeat('p', CAST(user_id % 3 AS INT))"})
    return L.validate_requests(rows).select("request_id", "kind", "reject_reason")
