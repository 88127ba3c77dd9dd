"""Checklist coercion, scoring, guard rails, recipes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import scores as S
from quire.operators import audit, recipe, replies
from quire.operators.audit import DIMENSIONS
from quire.plans.inputs import derive
from quire.plans.registry import query
from quire.sources.pages import table

KEYS = [k for k, *_ in DIMENSIONS]
DIM_CASE = "CASE {0} % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYS)) + " END"


def select(fields: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {source}"


ITEM = {
    "paper_id": "l_orderkey", "dim_key": DIM_CASE.format("l_partkey"), "ord": "CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey",
    "parameter": "CASE WHEN l_suppkey % 10 = 0 THEN ' ' WHEN l_suppkey % 10 = 1 THEN NULL ELSE concat(' Part ', l_partkey, repeat(' long', CAST(l_quantity AS INT)), ' ') END",
    "status": "CASE l_returnflag WHEN 'A' THEN ' Specified ' WHEN 'R' THEN 'partial' ELSE CASE l_linestatus WHEN 'O' THEN 'INFERRED' ELSE 'bogus' END END",
    "value": "CASE WHEN l_tax = 0 THEN 'null' WHEN l_discount = 0 THEN '' ELSE CAST(l_partkey AS STRING) END",
    "citation_page": "CASE l_linenumber WHEN 1 THEN '3' WHEN 2 THEN 'p. 4' WHEN 3 THEN ' 12 ' WHEN 4 THEN '' END",
    "risk_level": "CASE WHEN l_discount > 0.05 THEN 'HIGH' WHEN l_discount > 0.03 THEN 'medium' ELSE 'unclear' END",
    "note": "CASE WHEN l_tax > 0.05 THEN repeat('n', 450) WHEN l_tax > 0.02 THEN ' fine ' END",
}
CLEAN_SQL = f"""raw AS ({select(ITEM, "lineitem")}),
low AS (SELECT *, CASE WHEN lower(trim(status)) IN ('specified', 'partial', 'inferred', 'missing') THEN lower(trim(status)) ELSE 'missing' END AS st FROM raw WHERE trim(coalesce(parameter, '')) <> ''),
items AS (SELECT paper_id, dim_key, ord, left(trim(parameter), 120) AS parameter, st AS status, CASE WHEN value IN ('', 'null', 'None') THEN NULL ELSE left(value, 200) END AS value,
  TRY_CAST(trim(citation_page) AS BIGINT) AS citation_page,
  CASE WHEN lower(risk_level) IN ('low', 'medium', 'high') THEN lower(risk_level) WHEN st = 'missing' THEN 'high' WHEN st = 'specified' THEN 'low' ELSE 'medium' END AS risk_level,
  coalesce(nullif(left(trim(coalesce(note, '')), 400), ''), 'No further detail.') AS note FROM low)"""


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "lineitem", ITEM, wide=True)


def papers(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "orders", {"paper_id": "o_orderkey", "title": "concat('Order ', o_orderkey, ' of ', o_custkey)"})


@query("f6_clean_items", f"WITH {CLEAN_SQL} SELECT * FROM items")
def clean_items(spark: SparkSession, d: str) -> DataFrame:
    return audit.clean_items(raw_items(spark, d))


CHECKLIST = "[" + ", ".join("{'k': '%s', 'c': [%s]}" % (k, ", ".join(f"'{c}'" for c in items)) for k, _, _, _, items, _ in DIMENSIONS) + "]"
FILL_SQL = f"""{CLEAN_SQL}, want AS (SELECT o_orderkey AS paper_id, unnest({CHECKLIST}) AS x FROM orders),
empty AS (SELECT paper_id, x.k AS dim_key, x.c AS c FROM want ANTI JOIN items ON items.paper_id = want.paper_id AND items.dim_key = want.x.k),
filled AS (SELECT paper_id, dim_key, ord, parameter, status, value, citation_page, risk_level, note FROM items
  UNION ALL SELECT paper_id, dim_key, i - 1, c[i], 'missing', NULL, NULL, 'high', 'The auditor found no evidence for this item.' FROM (SELECT paper_id, dim_key, c, unnest(generate_series(1, len(c))) AS i FROM empty))"""


def filled(spark: SparkSession, d: str) -> DataFrame:
    return audit.fill_missing_items(papers(spark, d), audit.clean_items(raw_items(spark, d)))


@query("f7_fill_missing_items", f"WITH {FILL_SQL} SELECT * FROM filled")
def fill_missing_items(spark: SparkSession, d: str) -> DataFrame:
    return filled(spark, d)


RUBRIC_SQL = f"""rub AS (SELECT l_orderkey AS paper_id, {DIM_CASE.format('l_partkey')} AS dim_key, max(l_partkey) AS m FROM lineitem GROUP BY ALL),
rubric AS (SELECT paper_id, dim_key, CASE m % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '140' WHEN 2 THEN NULL WHEN 3 THEN '-7' ELSE CAST(m % 100 AS VARCHAR) END AS score FROM rub)"""
SCORE_SQL = f"""{FILL_SQL}, {RUBRIC_SQL},
share AS (SELECT paper_id, dim_key, 10 * sum(CASE status WHEN 'specified' THEN 10 WHEN 'partial' THEN 5 WHEN 'inferred' THEN 4 ELSE 0 END)::DOUBLE / count(*) AS i FROM filled GROUP BY ALL),
both_ AS (SELECT paper_id, dim_key, i, greatest(0.0::DOUBLE, least(100.0::DOUBLE, TRY_CAST(score AS DOUBLE))) AS r, TRY_CAST(score AS DOUBLE) IS NOT NULL AS has FROM share FULL JOIN rubric USING (paper_id, dim_key)),
blended AS (SELECT paper_id, dim_key, CASE WHEN NOT has THEN coalesce(i, 0) WHEN i IS NULL THEN r ELSE 0.5::DOUBLE * r + 0.5::DOUBLE * i END AS s FROM both_),
scores AS (SELECT paper_id, dim_key, CASE WHEN s % 1 IN (0.25, 0.75) THEN round_even(s, 1) ELSE round(s, 1) END AS score FROM blended)"""


def rubrics(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    text = F.when(m % 5 == 0, "n/a").when(m % 5 == 1, "140").when(m % 5 == 3, "-7").when(m % 5 == 4, (m % 100).cast("string"))
    keyed = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "dim_key": DIM_CASE.format("l_partkey"), "m": "l_partkey"})
    return keyed.groupBy("paper_id", "dim_key").agg(F.max("m").alias("m")).select("paper_id", "dim_key", text.alias("score"))


@query("f8_score_dimensions", f"WITH {SCORE_SQL} SELECT * FROM scores")
def score_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return audit.score_dimensions(filled(spark, d), rubrics(spark, d))


SIGNAL = {
    "paper_id": "o_orderkey", "has_url": "o_orderstatus <> 'F'", "code_promise": "CAST(o_custkey % 2 AS BIGINT)",
}
LINK = {
    "paper_id": "o_orderkey", "ord": "CAST(1 AS BIGINT)", "url": "concat('https://github.com/o', o_custkey)",
    "code": "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 200 WHEN '2' THEN 404 WHEN '3' THEN 503 WHEN '4' THEN 403 ELSE 301 END",
}
CAP_SQL = f"""{SCORE_SQL}, sig AS ({select(SIGNAL, "orders")}),
lk AS (SELECT *, CASE WHEN code < 400 THEN 'live' WHEN code = 404 THEN 'dead' ELSE 'open' END AS st FROM ({select(LINK, "orders WHERE o_orderstatus = 'O'")})),
lim AS (SELECT sig.paper_id, url, code, st, CASE WHEN st = 'dead' THEN 20.0 WHEN st IS NOT NULL THEN NULL WHEN NOT has_url AND code_promise > 0 THEN 20.0 WHEN NOT has_url THEN 10.0 END AS cap FROM sig LEFT JOIN lk USING (paper_id)),
capped AS (SELECT paper_id, dim_key, CASE WHEN dim_key = 'artifacts' AND score > cap THEN cap ELSE score END AS score, dim_key = 'artifacts' AND score > cap AS bites FROM scores LEFT JOIN lim USING (paper_id))"""
ADDED_SQL = """SELECT paper_id, 'artifacts' AS dim_key, 'Repository link live check' AS parameter, CASE st WHEN 'live' THEN 'specified' WHEN 'dead' THEN 'missing' ELSE 'partial' END AS status, url AS value,
  CASE st WHEN 'live' THEN 'low' WHEN 'dead' THEN 'high' ELSE 'medium' END AS risk_level,
  CASE st WHEN 'live' THEN '1/1 repository link(s) resolved.' WHEN 'dead' THEN '0/1 repository link(s) resolved.' ELSE concat('URL found in the text but could not be verified (', code, ').') END AS note FROM lim WHERE st IS NOT NULL
UNION ALL SELECT paper_id, 'artifacts', 'Repository URL', 'missing', NULL, 'high', 'No GitHub/GitLab/Hugging Face/Zenodo URL appears anywhere in the paper text.' FROM capped JOIN lim USING (paper_id) WHERE bites AND st IS NULL"""


def paper_signals(spark: SparkSession, d: str) -> DataFrame:
    urls = F.when(F.col("has_url"), F.array(F.concat(F.lit("https://www.github.com/s"), F.col("paper_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    names = F.when(F.col("code_promise") > 0, F.array(F.lit("A100"))).otherwise(F.array().cast("array<string>"))
    return derive(spark, d, "orders", SIGNAL).withColumns(
        {"repo_urls": urls, "accelerator_names": names, "seed": F.col("code_promise"), "variance": F.col("code_promise")}
    )


def paper_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_orderstatus = 'O'").selectExpr(*[f"{e} AS {n}" for n, e in LINK.items()])
    return rows.select("paper_id", "ord", "url", S.link_state(F.col("code")).alias("live"), F.col("code").cast("string").alias("status"))


def capped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return audit.cap_artifacts(score_dimensions(spark, d), paper_signals(spark, d), paper_links(spark, d))


@query("f9_cap_artifacts", f"WITH {CAP_SQL} SELECT paper_id, dim_key, score FROM capped")
def cap_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return capped(spark, d)[0]


@query("f9_artifact_items", f"WITH {CAP_SQL} {ADDED_SQL}")
def artifact_items(spark: SparkSession, d: str) -> DataFrame:
    return capped(spark, d)[1].drop("ord", "citation_page")


WEIGHT = "CASE dim_key " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, _, w, *_ in DIMENSIONS) + " END"
GRADE = "CASE " + " ".join(f"WHEN {{0}} >= {t} THEN '{g}'" for t, g, _ in S.GRADES) + " ELSE 'F' END"
LABEL = "CASE " + " ".join(f"WHEN {{0}} >= {t} THEN '{c}'" for t, _, c in S.GRADES) + " ELSE 'Non-Reproducible' END"


@query(
    "f10_overall",
    f"WITH {CAP_SQL}, o AS (SELECT paper_id, round(CAST(sum(CAST(score * 10 AS BIGINT) * CAST({WEIGHT} * 100 AS BIGINT)) AS DOUBLE) / 1000, 1) AS overall_score FROM (SELECT paper_id, dim_key, round(score, 1) AS score FROM capped) GROUP BY 1) "
    f"SELECT paper_id, overall_score, {GRADE.format('overall_score')} AS grade, {LABEL.format('overall_score')} AS classification FROM o",
)
def overall(spark: SparkSession, d: str) -> DataFrame:
    return audit.overall(capped(spark, d)[0])


@query(
    "f11_grade_for",
    f"WITH s AS (SELECT l_orderkey AS paper_id, l_linenumber AS n, l_quantity * 2 + l_discount AS score FROM lineitem) SELECT paper_id, n, score, {GRADE.format('score')} AS grade, {LABEL.format('score')} AS classification FROM s",
)
def grade_for(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "n": "l_linenumber", "score": "l_quantity * 2 + l_discount"})
    return rows.withColumns({"grade": S.grade_for(F.col("score")), "classification": S.classification_for(F.col("score"))})


@query(
    "f12_cap_lists",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents)
SELECT doc_id, array_to_string(list_transform(x[1:15], lambda v: left(v, 200)), '|') AS missing, array_to_string(list_transform(x[1:10], lambda v: left(v, 300)), '|') AS leakage FROM l""",
)
def cap_lists(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.split("text", "\n").alias("x"))
    return lines.select(
        "doc_id", F.array_join(audit.cap_missing(F.col("x")), "|").alias("missing"), F.array_join(audit.cap_leakage(F.col("x")), "|").alias("leakage")
    )


SIZE = {"part": "p_partkey", "billions": "CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = 1 THEN CAST(-p_size AS STRING) ELSE CAST(p_size AS STRING) END"}


@query(
    "f13_estimate_vram",
    f"WITH s AS ({select(SIZE, 'part')}), p AS (SELECT part, TRY_CAST(billions AS DOUBLE) AS p FROM s) "
    "SELECT part, CASE WHEN p > 0 THEN round(p * 2 * 1.2::DOUBLE, 1) END AS inference_gb, CASE WHEN p > 0 THEN round(p * 16 * 1.2::DOUBLE, 1) END AS training_gb FROM p",
)
def estimate_vram(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "part", SIZE).withColumn("v", S.estimate_vram(F.col("billions")))
    return rows.select("part", "v.inference_gb", "v.training_gb")


RECIPE = {
    "paper_id": "p_partkey", "model_name": "CASE WHEN p_size % 3 = 0 THEN 'null' ELSE p_name END",
    "parameter_count_billions": SIZE["billions"], "framework": "CASE WHEN p_size % 2 = 0 THEN ' PyTorch ' END", "python_version": "CASE WHEN p_size % 5 = 0 THEN '3.11' ELSE '' END",
    "cuda_version": "CAST(NULL AS STRING)", "hardware": "CASE WHEN p_size % 2 = 1 THEN concat(p_size, 'x A100') ELSE 'unknown' END",
    "training_time": "CASE WHEN p_size > 30 THEN '3 days' END", "dataset": "CASE WHEN p_size > 20 THEN p_type END",
}
ARGS = {"learning_rate": "'3e-4'", "batch_size": "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) ELSE 'not specified' END", "optimizer": "concat('Adam ', p_name)", "lr_schedule": "CASE WHEN p_size % 3 = 0 THEN concat('it''s ', p_type) END"}
_ARG = lambda a: f"a_{a}" if a in ARGS else "NULL"
LINE = lambda a: f"concat('  --{a} ', CASE WHEN {_ARG(a)} IS NULL OR {_ARG(a)} = 'not specified' THEN '<SWEEP>' WHEN regexp_full_match({_ARG(a)}, '[A-Za-z0-9_.+-]+') THEN {_ARG(a)} WHEN contains({_ARG(a)}, '''') THEN concat('\"', {_ARG(a)}, '\"') ELSE concat('''', {_ARG(a)}, '''') END)" if a in ARGS else f"'  --{a} <SWEEP>'"
WARN = lambda a: f"CASE WHEN {_ARG(a)} IS NULL OR {_ARG(a)} = 'not specified' THEN '- `{a}` is not reported: sweep it or start from the framework default.' END"
RECIPE_SQL = f"""r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in RECIPE.items())}, {", ".join(f"{e} AS a_{n}" for n, e in ARGS.items())} FROM part),
v AS (SELECT *, TRY_CAST(parameter_count_billions AS DOUBLE) AS p, CASE WHEN model_name = 'null' THEN 'architecture_from_paper' ELSE model_name END AS model, CASE WHEN hardware = 'unknown' THEN 'Not reported' ELSE hardware END AS hw FROM r),
c AS (SELECT *, round(p * 2 * 1.2::DOUBLE, 1) AS inf, round(p * 16 * 1.2::DOUBLE, 1) AS trn,
  concat_ws(' \\' || chr(10), 'python train.py', concat('  --model_name "', model, '"'), {", ".join(LINE(a) for a in recipe.ARGUMENTS)}, coalesce(concat('  --dataset "', nullif(dataset, ''), '"'), '')) AS cmd0 FROM v),
m AS (SELECT *, CASE WHEN dataset IS NULL THEN regexp_replace(cmd0, '  --dataset ""$', '  --dataset <UNSPECIFIED>') ELSE cmd0 END AS recipe_command,
  CASE WHEN p > 0 THEN concat(hw, ' | est. VRAM: ~', inf, ' GB inference, ~', trn, ' GB full training') ELSE hw END AS estimated_hardware FROM c),
recipes AS (SELECT paper_id, recipe_command, estimated_hardware, concat_ws(chr(10), '## Reproduction Recipe: ' || model, '', '### 1. Target hardware', '- **Reported hardware:** ' || hw,
  '- **Reported training time:** ' || coalesce(training_time, 'Not reported'),
  CASE WHEN p > 0 THEN concat('- **Estimated VRAM** (', parameter_count_billions, 'B params): ~', inf, ' GB for fp16 inference, ~', trn, ' GB for full mixed-precision Adam training (before sharding).') END,
  '', '### 2. Environment blueprint', '- **Framework:** ' || coalesce(trim(framework), 'Not reported'), '- **Python:** ' || coalesce(nullif(python_version, ''), 'Not reported (3.10+ recommended)'), '- **CUDA:** Not reported',
  '- **Libraries:** torch, ' || model_name, '', '### 3. Execution command', '```bash', recipe_command, '```', '', '### 4. Missing parameter warnings',
  {", ".join(WARN(a) for a in recipe.ARGUMENTS)}, '- Warmup steps') AS reproduction_recipe FROM m)"""


def recipes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(*[f"{e} AS {n}" for n, e in RECIPE.items()], *[f"{e} AS a_{n}".replace("it''s", "it\\'s") for n, e in ARGS.items()])
    rows = rows.withColumns(
        {
            "libraries": F.array(F.lit("torch"), F.lit(""), F.col("model_name")),
            "missing": F.array(F.lit(""), F.lit("Warmup steps")),
            "arguments": F.create_map(*[x for a in ARGS for x in (F.lit(a), F.col(f"a_{a}"))]),
        }
    )
    return recipe.synthesize_recipe(rows)


@query("f14_synthesize_recipe", f"WITH {RECIPE_SQL} SELECT * FROM recipes")
def synthesize_recipe(spark: SparkSession, d: str) -> DataFrame:
    return recipes(spark, d).select("paper_id", "recipe_command", "estimated_hardware", "reproduction_recipe")


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of all orders: items from line items, recipe and lists from a reply per order."""
    made = {
        "paper_id": "o_orderkey", "missing": "array(concat(' Warmup ', o_orderpriority, ' '), ' ')", "leakage": "CASE WHEN o_orderstatus = 'P' THEN array('overlap', 'order of dates') ELSE array() END",
        "model_name": "concat('model-', o_custkey)", "parameter_count_billions": "'7'", "hardware": "CASE WHEN o_orderstatus = 'F' THEN '8x A100' END",
        **{c: "CAST(NULL AS STRING)" for c in ("framework", "python_version", "cuda_version", "training_time", "dataset")},
        "libraries": "CAST(NULL AS ARRAY<STRING>)", "arguments": "map('seed', CAST(o_custkey AS STRING))",
    }
    out = audit.build_report(papers(spark, d), raw_items(spark, d), rubrics(spark, d), paper_signals(spark, d), paper_links(spark, d), derive(spark, d, "orders", made))
    return out.withColumn("created_at", F.lit("2024-01-01T00:00:00+00:00"))


@query("f15_build_report")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d)


# Items of one order as report text; full copies of a line item are told apart by nothing and stay.
REPORT_SQL = f"""{CAP_SQL}, added AS ({ADDED_SQL}),
allitems AS (SELECT paper_id, dim_key, ord, parameter, status, value, citation_page, risk_level, note FROM filled UNION ALL SELECT paper_id, dim_key, -1, parameter, status, value, NULL, risk_level, note FROM added),
shown AS (SELECT *, CAST(CASE dim_key {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KEYS))} END AS INT) AS dn,
  concat('- ', CASE status WHEN 'specified' THEN '[x]' WHEN 'partial' THEN '[~]' WHEN 'inferred' THEN '[?]' ELSE '[ ]' END, ' **', parameter, '**', coalesce(' = `' || value || '`', ''), coalesce(' (p. ' || citation_page || ')', ''), ': ', note, ' _Risk: ', risk_level, '._') AS line FROM allitems),
tot AS (SELECT paper_id, round(CAST(sum(CAST(score * 10 AS BIGINT) * CAST({WEIGHT} * 100 AS BIGINT)) AS DOUBLE) / 1000, 1) AS o FROM (SELECT paper_id, dim_key, round(score, 1) AS score FROM capped) GROUP BY 1)"""
ORDER_ITEM = "ord, parameter, status, value NULLS FIRST, citation_page NULLS FIRST, risk_level, note"


@query(
    "f15_report_categories",
    f"""WITH {REPORT_SQL}, n AS (SELECT paper_id, dim_key, max(dn) AS ord, count(*) AS n_items, count(*) FILTER (status = 'missing') AS n_missing FROM shown GROUP BY 1, 2)
SELECT paper_id, ord, dim_key AS key, round(score, 1) AS score, n_items, n_missing, o AS overall_score FROM capped JOIN n USING (paper_id, dim_key) JOIN tot USING (paper_id)""",
)
def report_categories(spark: SparkSession, d: str) -> DataFrame:
    """The report's categories, one row each."""
    rows = reports(spark, d).select("paper_id", "overall_score", F.explode("categories").alias("c"))
    missing = F.size(F.filter("c.items", lambda i: i["status"] == "missing")).cast("bigint")
    return rows.select("paper_id", "c.ord", "c.key", "c.score", F.size("c.items").cast("bigint").alias("n_items"), missing.alias("n_missing"), "overall_score")


@query(
    "f16_reviewer_questions",
    f"""WITH {REPORT_SQL}, q AS (SELECT paper_id, concat('Please report: ', parameter, '.') AS question, row_number() OVER (PARTITION BY paper_id ORDER BY dn, {ORDER_ITEM}) AS n FROM shown WHERE status = 'missing' AND risk_level = 'high')
SELECT paper_id, n, question FROM q WHERE n <= 10""",
)
def reviewer_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = reports(spark, d).select("paper_id", F.posexplode(recipe.reviewer_questions(F.col("categories"))).alias("n", "question"))
    return asked.withColumn("n", (F.col("n") + 1).cast("bigint"))


@query(
    "f16_scorecard_items",
    f"WITH {REPORT_SQL} SELECT paper_id, string_agg(line, chr(10) ORDER BY dn, {ORDER_ITEM}) AS lines FROM shown GROUP BY 1",
)
def scorecard_items(spark: SparkSession, d: str) -> DataFrame:
    cards = recipe.scorecard(reports(spark, d))
    lines = F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"^- \[[x~? ]\] "))
    return cards.select("paper_id", F.array_join(lines, "\n").alias("lines"))


@query(
    "a15_exported_scorecards",
    f"""WITH {REPORT_SQL}, l AS (SELECT paper_id, count(*) AS n_lines FROM shown GROUP BY 1)
SELECT 'Order_' || o_orderkey || '_of_' || o_custkey || '_repro_scorecard' AS file_name, n_lines, '# Reproducibility Scorecard: Order ' || o_orderkey || ' of ' || o_custkey AS first_line
FROM orders JOIN l ON l.paper_id = o_orderkey""",
)
def exported_scorecards(spark: SparkSession, d: str) -> DataFrame:
    """Scorecards written to the shared folder and read again: name, item lines and first line."""
    from quire.plans.streams import run_folder

    path = run_folder(spark)
    recipe.export_scorecards(reports(spark, d), path)
    items = F.size(F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"^- \[[x~? ]\] "))).cast("bigint")
    return spark.read.parquet(path).select("file_name", items.alias("n_lines"), F.substring_index("markdown", "\n", 1).alias("first_line"))


@query("f16_scorecard")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return recipe.scorecard(reports(spark, d)).select("paper_id", "markdown")


@query(
    "f17_quick_badges",
    f"""WITH {REPORT_SQL}, sd AS (SELECT paper_id, arg_min({{'s': status, 'v': value}}, (dn, ord)) AS i FROM shown WHERE contains(lower(parameter), 'seed') GROUP BY 1),
b AS (SELECT o_orderkey AS paper_id, o_orderstatus AS os, o_custkey, st, i FROM orders LEFT JOIN lk ON lk.paper_id = o_orderkey LEFT JOIN sd ON sd.paper_id = o_orderkey),
x AS (SELECT paper_id, 1 AS ord, CASE WHEN st = 'live' THEN 'ok' WHEN st = 'dead' OR os = 'F' THEN 'bad' ELSE 'warn' END AS tone,
    CASE WHEN st = 'live' THEN 'Code: Verified (github)' WHEN st = 'dead' THEN 'Code: Dead link' WHEN os <> 'F' THEN 'Code: github (unverified)' ELSE 'Code: Missing' END AS label FROM b
  UNION ALL SELECT paper_id, 2, CASE WHEN i IS NULL OR i.s = 'missing' THEN 'bad' WHEN i.s = 'specified' THEN 'ok' ELSE 'warn' END,
    CASE WHEN i IS NULL OR i.s = 'missing' THEN 'Seeds: Missing (Risk: High)' ELSE 'Seeds: ' || coalesce(i.v, upper(i.s[1:1]) || i.s[2:]) END FROM b
  UNION ALL SELECT paper_id, 3, CASE WHEN os = 'F' THEN 'ok' WHEN o_custkey % 2 > 0 THEN 'warn' ELSE 'bad' END, CASE WHEN os = 'F' THEN 'Compute: 8x A100' WHEN o_custkey % 2 > 0 THEN 'Compute: A100' ELSE 'Compute: Not reported' END FROM b
  UNION ALL SELECT paper_id, 4, 'warn', '2 leakage risks' FROM b WHERE os = 'P')
SELECT paper_id, CAST(ord AS BIGINT) AS ord, tone, label FROM x""",
)
def quick_badges(spark: SparkSession, d: str) -> DataFrame:
    return recipe.quick_badges(reports(spark, d))


@query(
    "f18_score_band",
    "SELECT l_orderkey AS paper_id, l_linenumber AS n, CASE WHEN l_quantity * 2 >= 80 THEN 'success' WHEN l_quantity * 2 >= 60 THEN 'tertiary' ELSE 'error' END AS band FROM lineitem",
)
def score_band(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, "lineitem", {"paper_id": "l_orderkey", "n": "l_linenumber", "score": "l_quantity * 2"})
    return rows.select("paper_id", "n", S.score_band(F.col("score")).alias("band"))
