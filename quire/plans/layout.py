"""Captions, rules, regions, word grids, table grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import geometry as G
from quire.operators import grids
from quire.plans.inputs import TEXT_LINE_SQL, WORDS_SQL, derive, text_lines, words
from quire.plans.registry import query
from quire.session import spread


def select(fields: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {source}"


# RE2 has no lookahead; in this data a caption mark in capitals ends its line.
CAPTION = r"^\s*(?:(?:Table|Tab\.)\s*(?:[0-9]{1,2}|[IVX]{1,5})\s*(?:[:.|]|$)|TABLE\s*(?:[0-9]{1,2}|[IVX]{1,5})(?:[^A-Za-z0-9]|$))"
CAPTIONS_SQL = f"""tl AS ({TEXT_LINE_SQL}),
nx AS (SELECT *, lead(text) OVER w AS ntext, lead(top) OVER w AS ntop, lead(bottom) OVER w AS nbottom, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1
  FROM tl WINDOW w AS (PARTITION BY paper_id, page ORDER BY line_no)),
tk AS (SELECT *, coalesce(length(trim(text)) <= length(regexp_extract(text, '{CAPTION}')) + 1 AND ntop - bottom >= 0 AND ntop - bottom <= 8, false) AS takes
  FROM nx WHERE regexp_matches(text, '{CAPTION}')),
caps AS (SELECT paper_id, page, line_no, CASE WHEN takes THEN trim(text) || ': ' || trim(ntext) ELSE trim(text) END AS text,
  CASE WHEN takes THEN least(x0, nx0) ELSE x0 END AS x0, CASE WHEN takes THEN greatest(x1, nx1) ELSE x1 END AS x1, top,
  CASE WHEN takes THEN nbottom ELSE bottom END AS bottom FROM tk)"""


@query("c1_caption_lines", f"WITH {CAPTIONS_SQL} SELECT * FROM caps")
def caption_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.caption_lines(text_lines(spark, d))


BOX = {
    "paper_id": "o_custkey", "page": "o_orderkey % 4 + 1", "box_id": "o_orderkey",
    "x0": "CAST(60 + o_orderkey % 90 AS DOUBLE)", "x1": "CAST(160 + o_orderkey % 90 AS DOUBLE)",
    "top": "CAST(12 * (o_orderkey % 50) + 30 AS DOUBLE)", "bottom": "CAST(12 * (o_orderkey % 50) + 90 AS DOUBLE)",
}
BOX_SQL = select(BOX, "orders")


@query(
    "c2_nearest_caption",
    f"""WITH {CAPTIONS_SQL}, boxes AS ({BOX_SQL}),
near AS (SELECT b.*, c.text, c.line_no, CASE WHEN b.top - c.bottom BETWEEN 0 AND 60 THEN b.top - c.bottom WHEN c.top - b.bottom BETWEEN 0 AND 40 THEN c.top - b.bottom END AS gap
  FROM boxes b JOIN caps c ON b.paper_id = c.paper_id AND b.page = c.page AND c.x0 < b.x1 AND c.x1 > b.x0),
best AS (SELECT box_id, text AS caption FROM near WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY gap, line_no) = 1)
SELECT boxes.*, caption FROM boxes LEFT JOIN best USING (box_id)""",
)
def nearest_caption(spark: SparkSession, d: str) -> DataFrame:
    return G.nearest_caption(derive(spark, d, "orders", BOX), G.caption_lines(text_lines(spark, d)))


EDGE = {
    "paper_id": "l_orderkey", "page": "CAST(1 AS BIGINT)", "seq": "CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey",
    "orientation": "CASE WHEN l_returnflag = 'R' THEN 'v' ELSE 'h' END", "x0": "CAST(40 * l_linenumber AS DOUBLE)",
    "x1": "CAST(40 * l_linenumber AS DOUBLE) + l_quantity * 8", "top": "CAST(l_partkey % 12 AS DOUBLE)", "bottom": "CAST(l_partkey % 12 AS DOUBLE) + 0.5",
}
PAGE_OF_ORDER = {"paper_id": "o_orderkey", "page": "CAST(1 AS BIGINT)", "width": "CAST(612 AS DOUBLE)", "height": "CAST(792 AS DOUBLE)"}


@query(
    "c3_cluster_rules",
    f"""WITH RECURSIVE e AS ({select(EDGE, "lineitem")}),
w AS (SELECT paper_id, (top + bottom) / 2 AS y, x0, x1, row_number() OVER (PARTITION BY paper_id ORDER BY seq, top, x0, x1) AS i
  FROM e SEMI JOIN orders ON o_orderkey = paper_id WHERE orientation = 'h' AND x1 - x0 >= 153),
f AS (SELECT paper_id, i, [{{'y': y, 'x0': x0, 'x1': x1}}] AS r FROM w WHERE i = 1
  UNION ALL SELECT w.paper_id, w.i, CASE
      WHEN list_position(list_transform(f.r, lambda k: abs(k.y - w.y) <= 2 AND k.x0 < w.x1 AND k.x1 > w.x0), true) > 0 THEN
        list_transform(f.r, lambda k, n: CASE WHEN n = list_position(list_transform(f.r, lambda k: abs(k.y - w.y) <= 2 AND k.x0 < w.x1 AND k.x1 > w.x0), true)
          THEN {{'y': k.y, 'x0': least(k.x0, w.x0), 'x1': greatest(k.x1, w.x1)}} ELSE k END)
      ELSE list_append(f.r, {{'y': w.y, 'x0': w.x0, 'x1': w.x1}}) END
    FROM f JOIN w ON w.paper_id = f.paper_id AND w.i = f.i + 1),
l AS (SELECT paper_id, unnest(arg_max(r, i)) AS r FROM f GROUP BY paper_id)
SELECT paper_id, CAST(1 AS BIGINT) AS page, r.y AS y, r.x0 AS x0, r.x1 AS x1 FROM l""",
)
def cluster_rules(spark: SparkSession, d: str) -> DataFrame:
    return G.cluster_rules(derive(spark, d, "lineitem", EDGE), derive(spark, d, "orders", PAGE_OF_ORDER))


RULE = {
    "paper_id": "o_custkey", "page": "o_orderkey % 4 + 1", "y": "CAST(12 * (o_orderkey % 50) + 15 + o_orderkey % 7 AS DOUBLE)",
    "x0": "CAST(60 + o_orderkey % 20 AS DOUBLE)", "x1": "CAST(360 + o_orderkey % 90 AS DOUBLE)",
}
PAGE_OF_CUSTOMER = {"paper_id": "c_custkey", "width": "CAST(430 AS DOUBLE)", "height": "CAST(792 AS DOUBLE)"}
REGIONS_SQL = f"""{CAPTIONS_SQL}, rules AS ({select(RULE, "orders")}),
lim AS (SELECT c.*, coalesce((SELECT min(o.top) FROM caps o WHERE o.paper_id = c.paper_id AND o.page = c.page AND o.top > c.bottom), 792) AS nxt,
  coalesce((SELECT max(o.bottom) FROM caps o WHERE o.paper_id = c.paper_id AND o.page = c.page AND o.bottom < c.top), 0) AS prv FROM caps c),
near AS (SELECT l.*, r.y, r.x0 AS rx0, r.x1 AS rx1 FROM lim l JOIN rules r ON l.paper_id = r.paper_id AND l.page = r.page AND r.x0 < l.x1 + 50 AND r.x1 > l.x0 - 50),
side AS (SELECT *, 1 AS s, y - bottom AS away FROM near WHERE y > bottom - 1 AND y < nxt UNION ALL SELECT *, 2, top - y FROM near WHERE y > prv AND y < top + 1),
gaps AS (SELECT *, min(away) OVER (PARTITION BY line_no, s) AS first_gap, away - lag(away) OVER (PARTITION BY line_no, s ORDER BY away, rx0, rx1) AS step FROM side),
pick AS (SELECT line_no, arg_min(s, (first_gap, s)) AS s FROM gaps WHERE first_gap <= 30 GROUP BY line_no),
isl AS (SELECT g.*, sum(CASE WHEN step > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY g.line_no ORDER BY away, rx0, rx1 ROWS UNBOUNDED PRECEDING) AS island
  FROM gaps g JOIN pick p ON g.line_no = p.line_no AND g.s = p.s),
regions AS (SELECT paper_id, page, line_no, text AS caption, greatest(0.0::DOUBLE, min(rx0)) AS x0, greatest(0.0::DOUBLE, min(y) - 1) AS top, least(430.0::DOUBLE, max(rx1)) AS x1,
  least(792.0::DOUBLE, max(y) + 1) AS bottom FROM isl WHERE island = 0 GROUP BY ALL HAVING count(*) >= 2)"""


def customer_pages(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "customer", PAGE_OF_CUSTOMER).select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    return G.booktabs_regions(G.caption_lines(text_lines(spark, d)), derive(spark, d, "orders", RULE), customer_pages(spark, d))


@query("c4_booktabs_regions", f"WITH {REGIONS_SQL} SELECT * FROM regions WHERE bottom - top >= 12")
def booktabs_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions(spark, d)


KEYS = ["paper_id", "page"]
ROWED_SQL = f"""{WORDS_SQL},
tops AS (SELECT paper_id, list_sort(list(DISTINCT top)) AS t FROM words GROUP BY 1),
anch AS (SELECT paper_id, list_reduce(t[2:], lambda a, x: CASE WHEN x - a[len(a)] <= 3 THEN a ELSE list_append(a, x) END, [t[1]]) AS a FROM tops),
rowed AS (SELECT w.*, CAST(len(list_filter(a, lambda k: k <= w.top)) - 1 AS BIGINT) AS row_no, len(a) AS n_rows FROM words w JOIN anch USING (paper_id))"""
CUTS_SQL = f"""{ROWED_SQL},
spans AS (SELECT paper_id, page, x0, max(x1) OVER (PARTITION BY paper_id ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT paper_id, page, x0, max(x1) AS x1 FROM rowed WHERE n_rows <= 2 OR row_no > 0 GROUP BY ALL)),
cuts AS (SELECT paper_id, page, (x0 + reach) / 2 AS cut FROM spans WHERE x0 - reach >= 7)"""
CELLS_SQL = f"""{CUTS_SQL},
cl AS (SELECT paper_id, list(cut) AS cuts FROM cuts GROUP BY 1),
pl AS (SELECT r.*, coalesce(cuts, []) AS cuts FROM rowed r LEFT JOIN cl USING (paper_id)),
cells AS (SELECT paper_id, page, row_no, len(list_filter(cuts, lambda k: k < (x0 + x1) / 2)) AS col_no, n_rows, len(cuts) + 1 AS n_cols,
  string_agg(text, ' ' ORDER BY x0, top, text) AS text FROM pl GROUP BY ALL)"""


@query("c5_cluster_rows", f"WITH {ROWED_SQL} SELECT * FROM rowed")
def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.cluster_rows(words(spark, d), KEYS)


@query("c6_infer_columns", f"WITH {CUTS_SQL} SELECT * FROM cuts")
def infer_columns(spark: SparkSession, d: str) -> DataFrame:
    return G.infer_columns(G.cluster_rows(words(spark, d), KEYS), KEYS)


@query("c7_words_to_cells", f"WITH {CELLS_SQL} SELECT * FROM cells")
def words_to_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.words_to_cells(words(spark, d), KEYS)


@query(
    "c7_words_to_matrix",
    f"""WITH {CELLS_SQL}, m AS (SELECT paper_id, page, n_rows, n_cols, map_from_entries(list((row_no * n_cols + col_no, text))) AS c FROM cells GROUP BY ALL)
SELECT paper_id, page, array_to_string(list_transform(generate_series(0, n_rows - 1), lambda i:
  array_to_string(list_transform(generate_series(0, n_cols - 1), lambda j: coalesce(c[i * n_cols + j], '')), '|')), chr(10)) AS grid FROM m""",
)
def words_to_matrix(spark: SparkSession, d: str) -> DataFrame:
    grid = G.words_to_matrix(words(spark, d), KEYS)
    return grid.select(*KEYS, F.array_join(F.transform("matrix", lambda r: F.array_join(r, "|")), "\n").alias("grid"))


# One raw grid per part, with gaps, ragged rows, blank rows and a blank column.
GRID_CELLS = [
    ["CASE WHEN p_size % 2 = 0 THEN p_type END", "NULL", "''", "CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END", "NULL"],
    ["concat('  Mo  del ', p_brand)", "CAST(p_size AS STRING)", "p_name", "concat('x|', p_partkey)", "' '"],
    ["NULL", "NULL", "''"],
    ["p_name", "CASE WHEN p_size > 25 THEN repeat(p_name, 40) ELSE 'ok' END", "CASE WHEN p_size % 5 = 0 THEN concat('v', p_size) END", "'1.5'", "NULL"],
]


def grid_sql(opening: str, closing: str) -> str:
    cell = "CAST({} AS STRING)"
    return opening + ", ".join(opening + ", ".join(cell.format(c) for c in row) + closing for row in GRID_CELLS) + closing


GRID_SQL = f"src AS (SELECT p_partkey AS paper_id, {grid_sql('[', ']')} AS raw FROM part)"
TIDY_SQL = """tidy AS (SELECT paper_id, list_transform(raw, lambda r: list_transform(r, lambda c: left(trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g')), 200))) AS m FROM src),
pad AS (SELECT paper_id, list_filter(list_transform(m, lambda r: list_resize(r, list_max(list_transform(m, lambda z: len(z))), '')), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS m FROM tidy),
clean AS (SELECT paper_id, list_transform(m, lambda r: list_transform(list_filter(range(1, len(m[1]) + 1), lambda j: len(list_filter(m, lambda q: q[j] <> '')) > 0), lambda j: r[j])) AS m FROM pad)"""
CLEAN_SQL = f"{GRID_SQL}, {TIDY_SQL}"
HEADED_SQL = """info AS (SELECT paper_id, m, len(m[1]) AS w, len(list_filter(m[1], lambda c: c <> '')) AS filled, len(list_filter(m[2], lambda c: c <> '')) AS filled2 FROM clean),
mrg AS (SELECT *, w > 2 AND filled <= w / 2.0 AND filled2 > filled AND len(m) > 1 AS merged,
  list_transform(m[1], lambda c, i: coalesce(list_filter(m[1][1:i], lambda k: k <> '')[-1], '')) AS top FROM info),
hd AS (SELECT paper_id, m, merged, CASE WHEN merged THEN list_transform(top, lambda t, i: CASE WHEN t <> '' AND t <> m[2][i] THEN trim(t || ' ' || m[2][i]) WHEN m[2][i] <> '' THEN m[2][i] ELSE t END) ELSE m[1] END AS h FROM mrg),
split AS (SELECT paper_id, list_transform(h, lambda c, i: CASE WHEN c = '' THEN 'Column ' || i ELSE c END) AS headers, CASE WHEN merged THEN m[3:] ELSE m[2:] END AS rows FROM hd)"""
SPLIT_SQL = f"{CLEAN_SQL}, {HEADED_SQL}"
FLAT = "array_to_string(list_transform({0}, lambda r: array_to_string(r, '¦')), chr(10))"


def raw_grids(spark: SparkSession, d: str) -> DataFrame:
    base = derive(spark, d, "part", {"paper_id": "p_partkey", "raw": grid_sql("array(", ")")})
    return spread(base)


def flat(c) -> F.Column:
    return F.array_join(F.transform(c, lambda r: F.array_join(r, "¦")), "\n")


def split(spark: SparkSession, d: str) -> DataFrame:
    cleaned = raw_grids(spark, d).select("paper_id", grids.clean_matrix(F.col("raw")).alias("m"))
    return cleaned.select("paper_id", grids.split_header(F.col("m")).alias("t")).select("paper_id", "t.headers", "t.rows")


@query("c8_clean_matrix", f"WITH {CLEAN_SQL} SELECT paper_id, {FLAT.format('m')} AS grid FROM clean")
def clean_matrix(spark: SparkSession, d: str) -> DataFrame:
    return raw_grids(spark, d).select("paper_id", flat(grids.clean_matrix(F.col("raw"))).alias("grid"))


@query("c9_split_header", f"WITH {SPLIT_SQL} SELECT paper_id, array_to_string(headers, '¦') AS headers, {FLAT.format('rows')} AS grid FROM split")
def split_header(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).select("paper_id", F.array_join("headers", "¦").alias("headers"), flat("rows").alias("grid"))


@query(
    "c10_plausible",
    f"""WITH {SPLIT_SQL}, s AS (SELECT paper_id, headers, rows, flatten(rows) AS c, list_filter(flatten(rows), lambda x: x <> '') AS f FROM split)
SELECT paper_id, len(headers) >= 2 AND len(rows) >= 1 AND len(f) / greatest(len(c), 1)::DOUBLE >= 0.35
  AND coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) / greatest(len(f), 1)::DOUBLE <= 60 AS plausible FROM s""",
)
def plausible(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).select("paper_id", grids.plausible(F.col("headers"), F.col("rows")).alias("plausible"))


MD_ROW = "'| ' || array_to_string(list_transform({0}, lambda c: replace(c, '|', '\\|')), ' | ') || ' |'"
MD_SQL = (
    f"array_to_string(list_concat([{MD_ROW.format('headers')}, {MD_ROW.format(chr(39).join(['list_transform(headers, lambda h: ', '---', ')']))}], "
    f"list_transform(rows, lambda r: {MD_ROW.format('r')})), chr(10))"
)


@query("c11_to_markdown", f"WITH {SPLIT_SQL} SELECT paper_id, {MD_SQL} AS markdown FROM split")
def to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).select("paper_id", grids.to_markdown(F.col("headers"), F.col("rows")).alias("markdown"))


PLACED = {
    "paper_id": "l_orderkey", "page": "CAST(l_linenumber AS BIGINT)", "x0": "CAST(l_suppkey AS DOUBLE)", "top": "l_partkey / 7", "x1": "l_extendedprice", "bottom": "l_quantity / 3",
}
PLACED["caption"] = "CASE l_returnflag WHEN 'A' THEN concat('Table of ', repeat('long caption ', CAST(l_quantity AS INT))) WHEN 'R' THEN '' END"


@query(
    "c12_number_tables",
    f"""WITH p AS ({select(PLACED, "lineitem")}), n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page, top, x0, x1, bottom, caption) AS table_index FROM p)
SELECT paper_id, page, table_index, left(coalesce(nullif(caption, ''), concat('Table ', table_index, ' (page ', page, ')')), 300) AS caption,
  concat_ws(',', CAST(round(x0 * 10) AS BIGINT), CAST(round(top * 10) AS BIGINT), CAST(round(round(x1, 1) * 10) AS BIGINT), CAST(round(bottom * 10) AS BIGINT)) AS bbox FROM n WHERE table_index <= 60""",
)
def number_tables(spark: SparkSession, d: str) -> DataFrame:
    out = grids.number_tables(derive(spark, d, "lineitem", PLACED))
    tenths = F.transform("bbox", lambda v: F.round(v * 10).cast("bigint").cast("string"))
    return out.select("paper_id", "page", "table_index", "caption", F.array_join(tenths, ",").alias("bbox"))


FOUND = {
    "paper_id": "o_custkey", "page": "o_orderkey % 4 + 1", "x0": "CAST(60 AS DOUBLE)", "x1": "CAST(200 AS DOUBLE)", "top": "CAST(12 * (o_orderkey % 50) AS DOUBLE)",
    "bottom": "CAST(12 * (o_orderkey % 50) + 40 AS DOUBLE)", "caption": "CASE WHEN o_orderpriority = '5-LOW' THEN concat('Table ', o_orderkey % 9 + 1, ': Order totals') END",
}
FOUND_WHERE = "o_orderstatus = 'F' AND o_orderpriority LIKE '%-%E%'"


@query(
    "c13_drop_overlaps",
    f"""WITH RECURSIVE {REGIONS_SQL}, fnd AS ({select(FOUND, "orders")} WHERE {FOUND_WHERE}),
taken AS (SELECT paper_id, page, list({{'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom, 'caption': caption, 'n': CAST(NULL AS BIGINT)}}) AS k FROM fnd GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY line_no) AS i FROM regions WHERE bottom - top >= 12),
st AS (SELECT q.paper_id, q.page, coalesce(k, []) AS k FROM (SELECT DISTINCT paper_id, page FROM q) q LEFT JOIN taken USING (paper_id, page)),
f AS (SELECT paper_id, page, CAST(0 AS BIGINT) AS i, k FROM st
  UNION ALL SELECT q.paper_id, q.page, q.i, CASE WHEN len(list_filter(f.k, lambda b: (q.x0 < b.x1 AND q.x1 > b.x0 AND q.top < b.bottom AND q.bottom > b.top) OR coalesce(b.caption = q.caption, false))) > 0
      THEN f.k ELSE list_append(f.k, {{'x0': q.x0, 'top': q.top, 'x1': q.x1, 'bottom': q.bottom, 'caption': q.caption, 'n': q.line_no}}) END
    FROM f JOIN q ON q.paper_id = f.paper_id AND q.page = f.page AND q.i = f.i + 1),
l AS (SELECT paper_id, page, unnest(k) AS b FROM (SELECT paper_id, page, arg_max(k, i) AS k FROM f GROUP BY paper_id, page))
SELECT paper_id, page, b.n AS line_no, b.caption AS caption, b.x0 AS x0, b.top AS top, b.x1 AS x1, b.bottom AS bottom FROM l WHERE b.n IS NOT NULL""",
)
def drop_overlaps(spark: SparkSession, d: str) -> DataFrame:
    from quire.sources.pages import table

    found = table(spark, d, "orders").filter(FOUND_WHERE).selectExpr(*[f"{e} AS {n}" for n, e in FOUND.items()])
    return G.drop_overlaps(regions(spark, d), found)


@query(
    "c14_table_search_text",
    f"""WITH {SPLIT_SQL} SELECT paper_id, left(concat('Table ', paper_id, ': Columns [', array_to_string(list_filter(headers, lambda c: c <> ''), ', '), ']. Rows: ',
  array_to_string(list_transform(rows, lambda r: array_to_string(list_filter(r, lambda c: c <> ''), ' | ')), '; ')), 300) AS search_text FROM split""",
)
def table_search_text(spark: SparkSession, d: str) -> DataFrame:
    caption = F.concat(F.lit("Table "), F.col("paper_id").cast("string"))
    return split(spark, d).select("paper_id", grids.search_text(caption, F.col("headers"), F.col("rows"), 300).alias("search_text"))


SEARCH_SQL = """left(concat(caption, ': Columns [', array_to_string(list_filter(headers, lambda c: c <> ''), ', '), ']. Rows: ',
  array_to_string(list_transform(rows, lambda r: array_to_string(list_filter(r, lambda c: c <> ''), ' | ')), '; ')), 2000)"""


@query(
    "c_extract_tables",
    f"""WITH {CELLS_SQL}, mp AS (SELECT paper_id, n_rows, n_cols, map_from_entries(list((row_no * n_cols + col_no, text))) AS c FROM cells GROUP BY ALL),
src AS (SELECT paper_id, list_transform(generate_series(0, n_rows - 1), lambda i: list_transform(generate_series(0, n_cols - 1), lambda j: coalesce(c[i * n_cols + j], ''))) AS raw FROM mp),
{TIDY_SQL}, {HEADED_SQL}, tall AS (SELECT split.* FROM split JOIN clean USING (paper_id) WHERE len(clean.m) >= 2),
fit AS (SELECT *, list_filter(flatten(rows), lambda x: x <> '') AS f, concat('Table 1: order ', paper_id) AS caption FROM tall)
SELECT paper_id, CAST(1 AS BIGINT) AS page, CAST(1 AS BIGINT) AS table_index, caption, {MD_SQL} AS markdown, {SEARCH_SQL} AS search_text FROM fit
WHERE len(headers) >= 2 AND len(rows) >= 1 AND len(f) / greatest(len(flatten(rows)), 1)::DOUBLE >= 0.35 AND coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) / greatest(len(f), 1)::DOUBLE <= 60""",
)
def extract_tables(spark: SparkSession, d: str) -> DataFrame:
    """Words of every order to a numbered, plausible table with Markdown."""
    grid = G.words_to_matrix(words(spark, d), KEYS).selectExpr(
        "paper_id", "page", "0D AS x0", "0D AS top", "200D AS x1", "792D AS bottom", "concat('Table 1: order ', paper_id) AS caption", "matrix"
    )
    return grids.extract_tables(grid).select("paper_id", "page", "table_index", "caption", "markdown", "search_text")
