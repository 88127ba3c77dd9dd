"""Context packing, sampling, prompts, and evidence signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import context as C
from quire.operators import prompts, search, signals
from quire.operators.audit import DIMENSIONS
from quire.operators.embedding import hash_embed
from quire.plans.inputs import EVIDENCE_SQL, buckets_sql, cosine_sql, derive, doc_chunks, doc_chunks_sql, doc_pages, doc_pages_sql, evidence
from quire.plans.registry import query
from quire.sources.pages import table

HIT = {"paper_id": "source", "chunk_index": "doc_id", "paper_name": "source", "page": "n_chars", "section": "CASE WHEN lang = 'en' THEN '' ELSE lang END", "text": "text"}
BLOCK_SQL = "concat('[', rn, '] ', source, ' | page ', n_chars, ' | ', CASE WHEN lang = 'en' THEN 'Unknown section' ELSE lang END, chr(10), text)"


@query(
    "e1_pack_prefix",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
b AS (SELECT source, doc_id, rn, {BLOCK_SQL} AS block FROM r), c AS (SELECT *, CAST(ceil(length(block) / 4.0) AS BIGINT) AS cost FROM b),
t AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY source ORDER BY rn) AS BIGINT) AS total FROM c)
SELECT source AS paper_id, doc_id AS chunk_index, rn AS ordinal, cost, total, md5(block) AS block_md5 FROM t WHERE rn = 1 OR total <= 6000""",
)
def pack_prefix(spark: SparkSession, d: str) -> DataFrame:
    hits = derive(spark, d, "documents", HIT)
    packed = C.pack_prefix(C.sized(hits), ["paper_id"], [F.col("chunk_index")], texts=hits)
    return packed.select("paper_id", "chunk_index", "ordinal", "cost", "total", F.md5(F.encode("block", "UTF-8")).alias("block_md5"))


@query(
    "e2_pack_greedy",
    """WITH l AS (SELECT source, list({'d': doc_id, 'c': CAST(ceil(length(text) / 4.0) AS BIGINT)} ORDER BY doc_id) AS items FROM documents GROUP BY 1),
f AS (SELECT source, list_reduce(items, lambda a, x: CASE WHEN a.t + x.c <= 1666 THEN {'t': a.t + x.c, 'k': list_append(a.k, x.d)} ELSE a END, {'t': CAST(0 AS BIGINT), 'k': CAST([] AS BIGINT[])}) AS s FROM l)
SELECT source AS paper_id, doc_id, ordinal FROM (SELECT source, unnest(s.k) AS doc_id, unnest(generate_series(1, len(s.k))) AS ordinal FROM f)""",
)
def pack_greedy(spark: SparkSession, d: str) -> DataFrame:
    items = derive(spark, d, "documents", {"paper_id": "source", "doc_id": "doc_id", "text": "text"})
    return C.pack_greedy(items, ["paper_id"], [F.col("doc_id")], F.col("text"), 1666, on=["paper_id", "doc_id"]).select("paper_id", "doc_id", "ordinal")


TABLES = {
    "paper_id": "p_brand", "table_index": "p_partkey", "page": "p_size",
    "caption": "concat('Table ', p_partkey, ': ', p_name, CASE WHEN p_size % 4 = 0 THEN ' Results' ELSE '' END)",
    "markdown": "concat('| ', p_type, ' | ', p_name, ' |', repeat(' x', p_size))",
}
TABLES_SQL = "tb AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TABLES.items()) + ", CASE WHEN p_size % 5 = 0 THEN ['Batch', p_type] ELSE ['A', p_type] END AS headers FROM part)"
PRIORITY_SQL = "CASE WHEN regexp_matches(caption || array_to_string(headers, ' '), 'hyper|parameter|setting|config|training|learning|batch|optimi|result|ablation|dataset|statistic|split', 'i') THEN 0 ELSE 1 END"


def hinted_tables(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "part", {**TABLES, "headers": "CASE WHEN p_size % 5 = 0 THEN array('Batch', p_type) ELSE array('A', p_type) END"})


@query("e3_rank_tables", f"WITH {TABLES_SQL} SELECT paper_id, table_index, CAST({PRIORITY_SQL} AS BIGINT) AS priority FROM tb")
def rank_tables(spark: SparkSession, d: str) -> DataFrame:
    return C.rank_tables(hinted_tables(spark, d)).select("paper_id", "table_index", "priority")


@query(
    "e3_select_tables",
    f"""WITH {TABLES_SQL}, b AS (SELECT *, {PRIORITY_SQL} AS p, concat('[Table ', table_index, ' | page ', page, '] ', caption, chr(10), markdown) AS block FROM tb),
l AS (SELECT paper_id, list({{'b': block, 'c': CAST(ceil(length(block) / 4.0) AS BIGINT)}} ORDER BY p, table_index) AS items FROM b GROUP BY 1),
f AS (SELECT paper_id, list_reduce(items, lambda a, x: CASE WHEN a.t + x.c <= 1666 THEN {{'t': a.t + x.c, 'k': list_append(a.k, x.b)}} ELSE a END, {{'t': CAST(0 AS BIGINT), 'k': CAST([] AS VARCHAR[])}}) AS s FROM l)
SELECT paper_id, coalesce(nullif(array_to_string(s.k, chr(10) || chr(10)), ''), '{C.NO_TABLES}') AS tables_block FROM f""",
)
def select_tables(spark: SparkSession, d: str) -> DataFrame:
    return C.select_tables(hinted_tables(spark, d))


def _queries(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "query_id string, text string").select("query_id", hash_embed(F.col("text")).alias("embedding"))


def _queries_sql(texts: dict[str, str]) -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in texts.items())
    return f"qs AS (SELECT k AS query_id, {buckets_sql('t')} AS q FROM (VALUES {rows}) v(k, t))"


def _best_sql(k: int, name: str = "best") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, c.*, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY {cosine_sql("b", "q")} DESC, chunk_index) AS rk
  FROM chunks c, qs) WHERE rk <= {k})"""


DIM_QUERIES = {key: text for key, _, _, text, _, _ in DIMENSIONS}


@query(
    "e4_gather_evidence",
    f"""WITH {doc_chunks_sql(5)}, {_queries_sql(DIM_QUERIES)}, {_best_sql(3)},
o AS (SELECT DISTINCT paper_id, chunk_index, '[p.' || page || ' | Body]' || chr(10) || trim(text) AS block FROM best),
c AS (SELECT *, CAST(ceil(length(block) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS ordinal FROM o),
t AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY paper_id ORDER BY ordinal) AS BIGINT) AS total FROM c)
SELECT paper_id, chunk_index, ordinal, cost, total FROM t WHERE ordinal = 1 OR total <= 900""",
)
def gather_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = C.gather_evidence(doc_chunks(spark, d, 5), _queries(spark, DIM_QUERIES), 900)
    return found.select("paper_id", "chunk_index", "ordinal", "cost", "total")


# One table per document with its whole text, some too large for a third of the budget; papers without
# evidence are numbers that no document has.
WHOLE_TABLES = {
    "paper_id": "doc_id", "table_index": "CAST(1 AS BIGINT)", "page": "CAST(1 AS BIGINT)", "caption": "concat('Table 1: ', source)", "markdown": "concat('| ', text)",
}



@query(
    "e_audit_inputs_whole",
    f"""WITH {doc_chunks_sql(5)}, {_queries_sql(DIM_QUERIES)}, {_best_sql(3)},
every AS (SELECT doc_id AS paper_id FROM documents UNION SELECT doc_id + 7 FROM labels),
tb AS (SELECT {", ".join(f"{e} AS {n}" for n, e in WHOLE_TABLES.items())} FROM documents),
blk AS (SELECT every.paper_id, concat('[Table 1 | page 1] ', caption, chr(10), markdown) AS x, CASE WHEN tb.paper_id IS NOT NULL AND length(x) <= 6664 THEN x ELSE '{C.NO_TABLES}' END AS tables_block FROM every LEFT JOIN tb ON tb.paper_id = every.paper_id),
o AS (SELECT DISTINCT paper_id, chunk_index, '[p.' || page || ' | Body]' || chr(10) || trim(text) AS block FROM best),
c AS (SELECT o.*, tables_block, CAST(ceil(length(block) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS n FROM o JOIN blk USING (paper_id)),
t AS (SELECT *, sum(cost) OVER (PARTITION BY paper_id ORDER BY n) AS total FROM c),
ctx AS (SELECT paper_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM t WHERE n = 1 OR total <= 5000 - ceil(length(tables_block) / 4.0) GROUP BY 1)
SELECT paper_id, tables_block, context, CASE WHEN context IS NULL THEN '{C.NO_CHUNKS}' || paper_id END AS reason FROM blk LEFT JOIN ctx USING (paper_id)""",
)
def audit_inputs_whole(spark: SparkSession, d: str) -> DataFrame:
    tables = derive(spark, d, "documents", {**WHOLE_TABLES, "headers": "array('a')"})
    papers = tables.select("paper_id").union(table(spark, d, "labels", "doc_id").selectExpr("doc_id + 7 AS paper_id"))
    made = C.audit_inputs(papers, doc_chunks(spark, d, 5), tables, _queries(spark, DIM_QUERIES))
    return made.select("paper_id", "tables_block", "context", "reason")


@query(
    "e5_sample_evenly",
    f"""WITH {doc_pages_sql(2)}, n AS (SELECT paper_id, count(*) AS n FROM pages GROUP BY 1)
SELECT paper_id, page - 1 AS chunk_index FROM pages JOIN n USING (paper_id)
WHERE n <= 12 OR list_contains(list_transform(generate_series(0, 11), lambda i: CAST(floor(i * (n / 12.0::DOUBLE)) AS BIGINT)), page - 1)""",
)
def sample_evenly(spark: SparkSession, d: str) -> DataFrame:
    return C.sample_evenly(doc_pages(spark, d, 2).select("paper_id", (F.col("page") - 1).alias("chunk_index")))


DUPLICATED = {"paper_id": "l_orderkey", "chunk_index": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey", "price": "l_extendedprice"}


@query(
    "e6_dedupe_first",
    "SELECT l_orderkey AS paper_id, l_linenumber AS chunk_index, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price FROM lineitem "
    "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1",
)
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_first(derive(spark, d, "lineitem", DUPLICATED), [F.col("part"), F.col("supp"), F.col("price")])


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels", "doc_id").selectExpr("doc_id AS request_id", "array(doc_id, doc_id div 2, doc_id + 7) AS paper_ids")


REQUESTS_SQL = """rq AS (SELECT doc_id AS request_id, unnest([doc_id, doc_id // 2, doc_id + 7]) AS paper_id, unnest([1, 2, 3]) AS pos FROM labels)"""


def _pack_sql(source: str, keys: str, budget: int) -> str:
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY chunk_index) AS rn FROM {source}),
bl AS (SELECT *, concat('[', rn, '] ', paper_name, ' | page ', page, ' | ', section, chr(10), trim(text)) AS block FROM o),
cs AS (SELECT *, sum(CAST(ceil(length(block) / 4.0) AS BIGINT)) OVER (PARTITION BY {keys} ORDER BY rn) AS total FROM bl),
kept AS (SELECT * FROM cs WHERE rn = 1 OR total <= {budget}),
ctx AS (SELECT {keys}, any_value(paper_name) AS title, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS context, count(*) AS n_used FROM kept GROUP BY {keys})"""


MISSING_SQL = f"""every AS (SELECT DISTINCT request_id FROM rq),
miss AS (SELECT request_id, '{C.NO_CHUNKS}' || string_agg(CAST(paper_id AS VARCHAR), ', ' ORDER BY pos) AS reason FROM rq WHERE paper_id NOT IN (SELECT paper_id FROM chunks) GROUP BY 1)"""
JOIN_PAPERS = "chr(10) || chr(10) || '===' || chr(10) || chr(10)"


@query(
    "e7_coverage_context",
    f"""WITH {doc_chunks_sql(2)}, {REQUESTS_SQL}, n AS (SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1),
smp AS (SELECT c.* FROM chunks c JOIN n USING (paper_id) WHERE n <= 12 OR list_contains(list_transform(generate_series(0, 11), lambda i: CAST(floor(i * (n / 12.0::DOUBLE)) AS BIGINT)), chunk_index)),
src AS (SELECT rq.request_id, rq.pos, smp.* FROM rq JOIN smp USING (paper_id)), {_pack_sql("src", "request_id, pos", 2000)}, {MISSING_SQL},
made AS (SELECT request_id, string_agg(context, {JOIN_PAPERS} ORDER BY pos) AS context, CAST(sum(n_used) AS BIGINT) AS n_used FROM ctx GROUP BY 1)
SELECT request_id, CASE WHEN reason IS NULL THEN context END AS context, CASE WHEN reason IS NULL THEN n_used END AS n_used, reason FROM every LEFT JOIN made USING (request_id) LEFT JOIN miss USING (request_id)""",
)
def coverage_context(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_context(requests(spark, d), doc_chunks(spark, d, 2))


@query(
    "e8_focused_context",
    f"""WITH {doc_chunks_sql(5)}, {REQUESTS_SQL}, {_queries_sql({"compare": prompts.COMPARE_QUERY})}, {_best_sql(6)},
u AS (SELECT DISTINCT paper_id, chunk_index, paper_name, page, section, text FROM (SELECT paper_id, chunk_index, paper_name, page, section, text FROM best
  UNION ALL SELECT paper_id, chunk_index, paper_name, page, section, text FROM chunks WHERE chunk_index < 1)),
src AS (SELECT rq.request_id, rq.pos, u.* FROM rq JOIN u USING (paper_id)), {_pack_sql("src", "request_id, pos", 2000)}, {MISSING_SQL},
made AS (SELECT request_id, string_agg('## ' || title || chr(10) || chr(10) || context, {JOIN_PAPERS} ORDER BY pos) AS context, string_agg(title, '; ' ORDER BY pos) AS titles, CAST(sum(n_used) AS BIGINT) AS n_used FROM ctx GROUP BY 1)
SELECT request_id, CASE WHEN reason IS NULL THEN context END AS context, CASE WHEN reason IS NULL THEN titles END AS titles, CASE WHEN reason IS NULL THEN n_used END AS n_used, reason
FROM every LEFT JOIN made USING (request_id) LEFT JOIN miss USING (request_id)""",
)
def focused_context(spark: SparkSession, d: str) -> DataFrame:
    return C.focused_context(requests(spark, d), doc_chunks(spark, d, 5), _queries(spark, {"compare": prompts.COMPARE_QUERY}))


@query(
    "e9_summary_context",
    f"""WITH {doc_chunks_sql(5)}, {_queries_sql(prompts.STYLE_QUERIES)}, {_best_sql(10)},
src AS (SELECT DISTINCT query_id, paper_id, chunk_index, paper_name, page, section, text FROM (SELECT query_id, paper_id, chunk_index, paper_name, page, section, text FROM best
  UNION ALL SELECT query_id, paper_id, chunk_index, paper_name, page, section, text FROM chunks, qs WHERE chunk_index < 2)), {_pack_sql("src", "query_id, paper_id", 6000)}
SELECT query_id, paper_id, title, n_used, md5(context) AS context_md5 FROM ctx""",
)
def summary_context(spark: SparkSession, d: str) -> DataFrame:
    made = C.summary_context(doc_chunks(spark, d, 5), _queries(spark, prompts.STYLE_QUERIES))
    return made.select("query_id", "paper_id", "title", "n_used", F.md5(F.encode("context", "UTF-8")).alias("context_md5"))


@query(
    "e10_render_prompt",
    """SELECT doc_id, concat('Context:', chr(10), text, chr(10), chr(10), 'Question:', chr(10), 'What about ', source, '?', chr(10), chr(10), 'Answer:') AS user_prompt FROM documents""",
)
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "documents", {"doc_id": "doc_id", "context": "text", "question": "concat('What about ', source, '?')"})
    return prompts.render_prompt(rows, "qa", "qa").select("doc_id", "user_prompt")


def _prompt_sql(kind: str, values: dict[str, str], source: str) -> str:
    """The template as a SQL concat, cut by hand at its places."""
    text, parts = prompts.TEMPLATES[kind], []
    while text:
        at = min((text.find("{" + n + "}"), n) for n in [*values, ""] if n and ("{" + n + "}") in text) if any("{" + n + "}" in text for n in values) else (len(text), "")
        if at[0]:
            parts.append("'" + text[: at[0]].replace("'", "''") + "'")
        if at[1]:
            parts.append(values[at[1]])
        text = text[at[0] + (len(at[1]) + 2 if at[1] else 0) :]
    return f"SELECT doc_id, concat({', '.join(parts)}) AS user_prompt FROM {source}"


SUMMARY_PLACES = {"title": "source", "context": "text", "instruction": "'Summarise.'"}


@query("e10_render_summary_prompt", _prompt_sql("summary", SUMMARY_PLACES, "documents"))
def render_summary_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "documents", {"doc_id": "doc_id", "title": "source", "context": "text"})
    return prompts.render_prompt(rows, "summary", instruction="Summarise.").select("doc_id", "user_prompt")


OTHER_PLACES = {
    "quiz": ("grounded", {"context": "text", "count": "doc_id % 9 + 1", "difficulty": "lang", "kind": "'mcq'", "format_hint": "source"}),
    "flashcards": ("grounded", {"context": "text", "count": "doc_id % 7 + 3"}),
    "compare": ("grounded", {"context": "text", "titles": "source"}),
    "gaps": ("grounded", {"context": "text"}),
}
for _kind, (_system, _places) in OTHER_PLACES.items():

    def _render(spark: SparkSession, d: str, kind: str = _kind, system: str = _system, places: dict = _places) -> DataFrame:
        rows = derive(spark, d, "documents", {"doc_id": "doc_id", **places})
        return prompts.render_prompt(rows, kind, system).select("doc_id", "user_prompt")

    query(f"e10_render_{_kind}_prompt", _prompt_sql(_kind, _places, "documents"))(_render)


@query("e10_render_table_prompt", _prompt_sql("qa", {"context": "text", "question": "lang"}, "documents"))
def render_table_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Questions about tables: the question template under the table rules."""
    rows = derive(spark, d, "documents", {"doc_id": "doc_id", "context": "text", "question": "lang"})
    return prompts.render_prompt(rows, "qa", "table_qa").select("doc_id", "user_prompt")


def _brief_sql() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return {"title": "source", "context": "text", "tables": "lang", "signals": "source", "dimensions": quoted(prompts.dimension_brief()), "recipe_args": quoted(prompts.recipe_arguments())}


@query("e10_render_audit_prompt", _prompt_sql("audit", _brief_sql(), "documents"))
def render_audit_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "documents", {"doc_id": "doc_id", "title": "source", "context": "text", "tables": "lang", "signals": "source"})
    return prompts.render_prompt(rows, "audit", "audit").select("doc_id", "user_prompt")


@query(
    "e11_split_answerable",
    """SELECT CAST(o_orderkey AS BIGINT) AS query_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'prompt'
  ELSE 'I don''t know - the uploaded papers do not contain enough information to answer that.' END AS outcome FROM orders""",
)
def split_answerable(spark: SparkSession, d: str) -> DataFrame:
    asked = derive(spark, d, "orders", {"query_id": "o_orderkey"})
    hits = derive(spark, d, "lineitem", {"query_id": "l_orderkey"})
    yes, no = C.split_answerable(asked, hits)
    return yes.withColumn("outcome", F.lit("prompt")).unionByName(no.withColumn("outcome", F.lit(prompts.NO_ANSWER)))


# Patterns that occur in the given text; the third one also runs over line ends.
HITS = {"mail": r"[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]+", "licence": "licen[cs]e|copyright", "and_next": r"and\s+[a-z]+", "digits": r"\d{3}[- ]\d{3,4}"}


@query(
    "f1_signal_counts",
    f"WITH {doc_pages_sql(5)}, t AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY page) AS text FROM pages GROUP BY 1) SELECT paper_id, "
    + ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) AS {n}" for n, p in HITS.items()) + " FROM t",
)
def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    texts = doc_pages(spark, d, 5).select("paper_id", (F.col("page") - 1).alias("seq"), "text")
    return signals.signal_counts(texts, HITS)


WORD = r"(?:^|[^A-Za-z0-9_])"
DEFAULTS_SQL = f"""ev AS ({EVIDENCE_SQL}), t AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY seq) AS text FROM ev GROUP BY 1)"""
PHRASES = {
    "seed": "seed [0-9]", "accelerator": "(H100|RTX 4090|P100|TPU v3|l40s)", "gpu_hours": "days on end", "variance": "(std|±)",
    "multiple_runs": "mean of 4 trials", "significance": "p = 0.02", "code_promise": "(data would be|models will be)",
    "code_available": "Weights are released", "environment": "(JAX|docker image)", "contamination": "(Contaminated|leaked)",
    "carbon": "(Energy consumption|kWh)",
}
COUNTS_SQL = "SELECT paper_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in PHRASES.items())


@query("f1_default_signals", f"WITH {DEFAULTS_SQL} {COUNTS_SQL} FROM t")
def default_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.signal_counts(evidence(spark, d))


URLS_SQL = f"""ev AS ({EVIDENCE_SQL}), u AS (SELECT paper_id, min(seq) AS seq, rtrim(regexp_extract(text, 'https?://gitlab[^ ]*'), '.') AS url FROM ev GROUP BY paper_id, url),
urls AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY seq) AS ord, url FROM u QUALIFY ord <= 8)"""
NAMES_SQL = """n AS (SELECT DISTINCT paper_id, upper(replace(regexp_extract(text, 'on two (.*) boards', 1), ' ', '')) AS name FROM ev),
names AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY name) AS ord, name FROM n QUALIFY ord <= 6)"""


@query("f2_repo_urls", f"WITH {URLS_SQL} SELECT * FROM urls")
def repo_urls(spark: SparkSession, d: str) -> DataFrame:
    return signals.repo_urls(evidence(spark, d))


@query(
    "f2_repo_urls_in_pages",
    r"""WITH m AS (SELECT page_id, regexp_extract_all(html || ' ' || url, '(?i)https?://[^\s)\]}>,;"'']+') AS us FROM pages),
x AS (SELECT page_id, unnest(us) AS u, unnest(generate_series(1, len(us))) AS i FROM m),
y AS (SELECT page_id, rtrim(u, '.') AS url, min(i) AS i FROM x WHERE regexp_matches(lower(u), 'example\.(com|net)') GROUP BY 1, 2)
SELECT page_id AS paper_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ord, url FROM y QUALIFY ord <= 8""",
)
def repo_urls_in_pages(spark: SparkSession, d: str) -> DataFrame:
    texts = derive(spark, d, "pages", {"paper_id": "page_id", "seq": "CAST(0 AS BIGINT)", "text": "concat(html, ' ', url)"})
    return signals.repo_urls(texts, hosts=("example.com", "example.net"))


@query("f3_accelerators", f"WITH ev AS ({EVIDENCE_SQL}), {NAMES_SQL} SELECT paper_id, ord, name FROM names")
def accelerators(spark: SparkSession, d: str) -> DataFrame:
    return signals.accelerators(evidence(spark, d)).select("paper_id", "ord", "name")


STATUS = {"url": "concat('https://gitlab.com/yard', l_partkey % 7, '/dock', l_suppkey % 3)", "status": "200 + l_partkey % 7 * 3 + (l_suppkey % 3) * 101"}
STATUS_SQL = "st AS (SELECT url, max(status) AS code FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in STATUS.items()) + " FROM lineitem) GROUP BY 1)"
LIVE_SQL = "CASE WHEN code < 400 THEN true WHEN code < 500 AND code NOT IN (401, 403, 407, 408, 429) THEN false END"
LINKS_SQL = f"""{URLS_SQL}, {STATUS_SQL}, links AS (SELECT paper_id, ord, urls.url, {LIVE_SQL} AS live, coalesce(CAST(code AS VARCHAR), 'not checked') AS status FROM urls LEFT JOIN st ON st.url = urls.url WHERE ord <= 3)"""


@query("f4_link_state", f"WITH s AS (SELECT DISTINCT 180 + l_partkey % 400 AS code FROM lineitem) SELECT code, {LIVE_SQL} AS live FROM s")
def link_state(spark: SparkSession, d: str) -> DataFrame:
    from quire.functions.scores import link_state as state

    return derive(spark, d, "lineitem", {"code": "180 + l_partkey % 400"}).distinct().withColumn("live", state(F.col("code")))


def links(spark: SparkSession, d: str) -> DataFrame:
    return signals.link_checks(signals.repo_urls(evidence(spark, d)), derive(spark, d, "lineitem", STATUS))


@query("f4_link_checks", f"WITH {LINKS_SQL} SELECT * FROM links")
def link_checks(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


NAMED_COUNTS = " || chr(10) || ".join(f"'- {n}: ' || {n} || ' mention(s)'" for n in signals.SIGNALS)


@query(
    "f5_signals_summary",
    f"""WITH {LINKS_SQL}, {NAMES_SQL}, t AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY seq) AS text FROM ev GROUP BY 1), c AS ({COUNTS_SQL} FROM t),
ua AS (SELECT paper_id, string_agg(url, ', ' ORDER BY ord) AS u FROM urls GROUP BY 1), na AS (SELECT paper_id, string_agg(name, ', ' ORDER BY ord) AS n FROM names GROUP BY 1),
la AS (SELECT paper_id, string_agg(chr(10) || '- link check ' || url || ': ' || CASE WHEN live THEN 'live' WHEN live IS NULL THEN 'unverified' ELSE 'DEAD (not found)' END || ' (' || status || ')', '' ORDER BY ord) AS l FROM links GROUP BY 1)
SELECT paper_id, {NAMED_COUNTS} || chr(10) || '- accelerators named: ' || coalesce(n, 'none') || chr(10) || '- repository URLs: ' || coalesce(u, 'none found') || coalesce(l, '') AS signals_text
FROM c LEFT JOIN ua USING (paper_id) LEFT JOIN na USING (paper_id) LEFT JOIN la USING (paper_id)""",
)
def signals_summary(spark: SparkSession, d: str) -> DataFrame:
    return signals.signals_summary(signals.scan_signals(evidence(spark, d)), links(spark, d)).select("paper_id", "signals_text")
