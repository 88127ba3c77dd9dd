"""Model replies, study sets, cell citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import citations, replies
from quire.plans.inputs import derive
from quire.plans.registry import query


def select(fields: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {source}"


# A reply per part, as JSON text: fenced, in prose, broken, a bare list, or plain.
QUIZ_BODY = """concat('{"questions": [{"question": " What is ', p_name, '? ", "options": ["', p_type, '", "', p_brand, ' x ", "', p_name, '"], "answer": "',
  CASE p_size % 6 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'B' WHEN 2 THEN p_name WHEN 3 THEN 'x' WHEN 4 THEN 'nothing' ELSE 'D' END, '", "explanation": ""}, "oops", {"question": "", "answer": "a"},
  {"question": "Second", "options": ["Only"], "answer": "true ', p_size, '", "explanation": "E', p_size, '"}]}')"""
QUIZ = {
    "reply_id": "p_partkey", "quiz_type": "CASE p_partkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'true_false' ELSE 'short_answer' END", "count": "CASE WHEN p_size > 40 THEN 1 ELSE 5 END",
    "p_name": "p_name", "p_type": "p_type", "p_brand": "p_brand", "p_size": "p_size",
    "reply": f"CASE p_partkey % 4 WHEN 0 THEN {QUIZ_BODY} WHEN 1 THEN concat('```json', chr(10), {QUIZ_BODY}, chr(10), '```') WHEN 2 THEN concat('Here it is: ', {QUIZ_BODY}, ' Enjoy.') ELSE concat('Sorry, no ', p_name, ' {{') END",
}
QUIZ_SQL = f"qz AS ({select(QUIZ, 'part')})"


@query(
    "g1_parse_model_json",
    rf"""WITH {QUIZ_SQL}, c AS (SELECT reply_id, regexp_replace(regexp_replace(trim(reply), '^```(?:json)?\s*', '', 'i'), '\s*```$', '') AS c FROM qz),
o AS (SELECT reply_id, c, regexp_extract(c, '(?s)(\{{.*\}}|\[.*\])', 1) AS x FROM c),
b AS (SELECT reply_id, CASE WHEN json_valid(c) THEN c WHEN x <> '' AND json_valid(x) THEN x END AS body FROM o)
SELECT reply_id, body IS NOT NULL AS parsed, body->>'$.questions[0].question' AS first_question, CASE WHEN body IS NULL THEN 'The model did not return valid JSON.' END AS error FROM b""",
)
def parse_model_json(spark: SparkSession, d: str) -> DataFrame:
    good, bad = replies.parse_replies(derive(spark, d, "part", QUIZ))
    ok = good.select("reply_id", F.lit(True).alias("parsed"), F.try_variant_get("body", "$.questions[0].question", "string").alias("first_question"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(bad.select("reply_id", F.lit(False).alias("parsed"), F.lit(None).cast("string").alias("first_question"), "error"))


@query(
    "g2_normalize_questions",
    f"""WITH {QUIZ_SQL}, a AS (SELECT reply_id, "count" AS n, quiz_type AS t, p_name, p_type, p_brand, p_size,
  CASE p_size % 6 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'B' WHEN 2 THEN p_name WHEN 3 THEN 'x' WHEN 4 THEN 'nothing' ELSE 'D' END AS given, [p_type, p_brand || ' x', p_name] AS opts FROM qz WHERE reply_id % 4 <> 3),
q AS (SELECT reply_id, n, 1 AS pos, 'What is ' || p_name || '?' AS question, CASE t WHEN 'mcq' THEN array_to_string(opts, '|') WHEN 'true_false' THEN 'True|False' END AS options,
    CASE t WHEN 'true_false' THEN CASE WHEN starts_with(lower(given), 't') THEN 'True' ELSE 'False' END WHEN 'short_answer' THEN given
      ELSE coalesce(list_filter(opts, lambda o: lower(o) = lower(given))[1], CASE WHEN length(given) = 1 AND strpos('ABC', upper(given)) > 0 THEN opts[strpos('ABC', upper(given))] END, list_filter(opts, lambda o: contains(lower(o), lower(given)))[1]) END AS answer, NULL AS explanation FROM a
  UNION ALL SELECT reply_id, n, 2, 'Second', CASE t WHEN 'true_false' THEN 'True|False' END, CASE t WHEN 'true_false' THEN 'True' WHEN 'short_answer' THEN 'true ' || p_size END, 'E' || p_size FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY pos) AS i FROM q WHERE answer IS NOT NULL)
SELECT reply_id, i AS item_no, question, options, answer, explanation FROM k WHERE i <= n""",
)
def normalize_questions(spark: SparkSession, d: str) -> DataFrame:
    good, _ = replies.parse_replies(derive(spark, d, "part", QUIZ, wide=True))
    # The outer form: for a plain one Spark makes the questions a second time, in a filter on empty lists.
    made = replies.normalize_questions(good).select("reply_id", F.posexplode_outer("questions").alias("i", "q")).filter("i IS NOT NULL")
    return made.select(
        "reply_id", (F.col("i") + 1).cast("bigint").alias("item_no"), "q.question", F.array_join("q.options", "|").alias("options"), "q.answer", "q.explanation"
    )


CARDS = {
    "reply_id": "p_partkey", "count": "CASE WHEN p_size > 40 THEN 1 ELSE 5 END", "p_name": "p_name", "p_size": "p_size",
    "reply": """concat('{"cards": [{"front": " ', p_name, ' ", "back": "back ', p_size, '", "explanation": "', CASE WHEN p_size % 2 = 0 THEN 'more' ELSE '' END, '"}, {"front": "no back"}, {"front": 7, "back": "seven"}]}')""",
}


@query(
    "g3_normalize_cards",
    f"""WITH c AS ({select(CARDS, 'part')}), k AS (SELECT reply_id, 1 AS i, "count" AS n, p_name AS front, 'back ' || p_size AS back, CASE WHEN p_size % 2 = 0 THEN 'more' END AS explanation FROM c
UNION ALL SELECT reply_id, 2, "count", '7', 'seven', NULL FROM c)
SELECT reply_id, CAST(i AS BIGINT) AS card_no, front, back, explanation FROM k WHERE i <= n""",
)
def normalize_cards(spark: SparkSession, d: str) -> DataFrame:
    good, _ = replies.parse_replies(derive(spark, d, "part", CARDS))
    made = replies.normalize_cards(good).select("reply_id", F.posexplode("cards").alias("i", "c"))
    return made.select("reply_id", (F.col("i") + 1).cast("bigint").alias("card_no"), "c.front", "c.back", "c.explanation")


GAPS = {
    "reply_id": "p_partkey", "p_name": "p_name", "p_size": "p_size",
    "reply": """concat('[{"title": "', p_name, '", "description": "d', p_size, '", "papers": ["A", "', p_name, '"], "confidence": "', CASE WHEN p_size % 2 = 0 THEN 'HIGH' ELSE 'Low' END, '"}, {"category": "limitation"}, 3]')""",
}


@query(
    "g4_normalize_gaps",
    f"""WITH g AS ({select(GAPS, 'part')})
SELECT reply_id, CAST(1 AS BIGINT) AS gap_no, p_name AS title, 'd' || p_size AS description, 'future_work' AS category, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, '' AS suggestion, 'A|' || p_name AS papers FROM g
UNION ALL SELECT reply_id, 2, 'Untitled gap', '', 'limitation', 'medium', '', '' FROM g""",
)
def normalize_gaps(spark: SparkSession, d: str) -> DataFrame:
    good, _ = replies.parse_replies(derive(spark, d, "part", GAPS))
    made = replies.normalize_gaps(good).select("reply_id", F.posexplode("gaps").alias("i", "g"))
    fields = ("title", "description", "category", "confidence", "suggestion")
    return made.select("reply_id", (F.col("i") + 1).cast("bigint").alias("gap_no"), *[f"g.{f}" for f in fields], F.array_join("g.papers", "|").alias("papers"))


GIVEN = {"session_id": "l_suppkey", "quiz_id": "l_orderkey", "item_no": "l_linenumber", "answer": "CASE WHEN l_partkey % 3 = 0 THEN concat(' ', l_returnflag, ' ') ELSE lower(l_returnflag) END"}
KEY = {"quiz_id": "l_orderkey", "item_no": "l_linenumber", "answer": "max(l_returnflag)"}


@query(
    "g5_grade_quiz",
    f"""WITH a AS ({select(GIVEN, 'lineitem')}), k AS ({select(KEY, 'lineitem')} GROUP BY 1, 2)
SELECT session_id, quiz_id, count(*) FILTER (lower(trim(a.answer)) = lower(trim(k.answer))) AS score, count(*) AS n_items FROM k JOIN a USING (quiz_id, item_no) GROUP BY 1, 2""",
)
def grade_quiz(spark: SparkSession, d: str) -> DataFrame:
    answers = derive(spark, d, "lineitem", GIVEN)
    key = derive(spark, d, "lineitem", {**KEY, "answer": "l_returnflag"}).groupBy("quiz_id", "item_no").agg(F.max("answer").alias("answer"))
    return replies.grade_quiz(answers, key)


# Answers citing cells of the table of a part's brand.
ANSWER = {
    "answer_id": "p_partkey", "paper_id": "p_brand",
    "answer": """concat('It is 3 [1] (Table ', p_size, ', row "', upper(p_name), '", column "Brand"), but (table ', p_size + 1, ' , Row “**', p_type, '**”, col ‘nothing’).')""",
}
REFS_SQL = f"""a AS ({select({**ANSWER, 'p_size': 'p_size', 'p_name': 'p_name', 'p_type': 'p_type'}, 'part')}),
refs AS (SELECT answer_id, paper_id, CAST(1 AS BIGINT) AS ref_no, CAST(p_size AS VARCHAR) AS table_no, lower(p_name) AS row_label, 'brand' AS col_label FROM a
  UNION ALL SELECT answer_id, paper_id, 2, CAST(p_size + 1 AS VARCHAR), lower(p_type), 'nothing' FROM a)"""


def refs(spark: SparkSession, d: str) -> DataFrame:
    return citations.cell_references(derive(spark, d, "part", ANSWER, wide=True))


@query("g6_cell_references", f"WITH {REFS_SQL} SELECT * FROM refs")
def cell_references(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d)


CITED = {"paper_id": "p_brand", "table_index": "p_partkey", "caption": "CASE WHEN p_size % 2 = 0 THEN concat('Table ', p_size, ': parts') ELSE concat('Tab. ', p_size, '. parts') END", "n": "p_name", "t": "p_type"}
CELLS_SQL = f"""{REFS_SQL}, tb AS ({select(CITED, 'part')}), nm AS (SELECT paper_id, table_index, n, t, unnest(list_distinct([CAST(table_index AS VARCHAR), regexp_extract(caption, '(\\d+)', 1)])) AS table_no FROM tb),
labels AS (SELECT paper_id, table_index, table_no, 0 AS row_no, lower(n) AS k FROM nm UNION ALL SELECT paper_id, table_index, table_no, 1, lower(t) FROM nm UNION ALL SELECT paper_id, table_index, table_no, 2, lower(n || ' ' || t) FROM nm),
heads AS (SELECT unnest([0, 1, 2]) AS col_no, unnest(['name', 'the brand', 'brand']) AS h),
cells AS (SELECT refs.*, table_index, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no FROM refs JOIN labels USING (paper_id, table_no), heads
  WHERE contains(k, row_label) AND contains(h, col_label))"""


def cited_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array("n", F.lit("1")), F.array("t", F.lit("2")), F.array(F.concat_ws(" ", "n", "t"), F.lit("3")))
    return derive(spark, d, "part", CITED, wide=True).withColumns({"headers": F.array(F.lit("Name"), F.lit("The *Brand*"), F.lit("brand")), "rows": rows})


@query("g7_resolve_cells", f"WITH {CELLS_SQL} SELECT * FROM cells")
def resolve_cells(spark: SparkSession, d: str) -> DataFrame:
    return citations.resolve_cells(refs(spark, d), cited_tables(spark, d))[0]


@query("g7_unresolved_cells", f"WITH {CELLS_SQL} SELECT * FROM refs WHERE (answer_id, ref_no) NOT IN (SELECT (answer_id, ref_no) FROM cells)")
def unresolved_cells(spark: SparkSession, d: str) -> DataFrame:
    return citations.resolve_cells(refs(spark, d), cited_tables(spark, d))[1]
