"""Page cleaning, sections, chunking, titles, abstracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import mathtext, text as T
from quire.operators import chunking, cleaning
from quire.plans.inputs import MANUSCRIPT_SQL, derive, doc_pages, doc_pages_sql, manuscripts
from quire.plans.registry import query
from quire.sources.pages import table, wide_table

# The rules as SQL. The given text has no white space beyond ASCII and no line break but \n.
KNOWN = ", ".join(f"'{s}'" for s in T.KNOWN_SECTIONS)
NUMBERED = r"^(\d{1,2}(\.\d{1,2})*\.?|[IVX]{1,4}\.)\s+([A-Z][A-Za-z\-,:& ]{2,60})$"
PAGE_NO = r"^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$"


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"


def heading_sql(line: str) -> str:
    t = f"trim({line})"
    numbered = f"regexp_extract({t}, '{NUMBERED}', 3)"
    plain = f"rtrim(lower({t}), ':.')"
    return (
        f"(CASE WHEN length({t}) = 0 OR length({t}) > 70 THEN NULL WHEN {numbered} <> '' THEN {title_sql(f'trim({numbered})')} "
        f"WHEN {plain} IN ({KNOWN}) THEN {title_sql(plain)} END)"
    )


LINES_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def edges_sql(source: str, threshold: str) -> str:
    return f"""src AS ({source}),
edges AS (SELECT paper_id, unnest(list_distinct(list_concat(l[1:3], l[greatest(len(l) - 2, 1):]))) AS line FROM (SELECT paper_id, {LINES_SQL} AS l FROM src)),
sizes AS (SELECT paper_id, count(*) AS n FROM src GROUP BY 1 HAVING count(*) >= 3),
noise AS (SELECT paper_id, line, count(*) AS n_pages FROM edges JOIN sizes USING (paper_id) GROUP BY paper_id, line, n HAVING count(*) >= {threshold})"""


def dropped_sql(extra: str = "") -> str:
    return f"""SELECT src.paper_id, page, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(nl, trim(x)), false)
  AND NOT regexp_matches(trim(x), '{PAGE_NO}', 'i')), chr(10)) AS text
FROM src LEFT JOIN (SELECT paper_id, list(line) AS nl FROM noise GROUP BY 1) USING (paper_id){extra}"""


DOCS_BY_SOURCE = {"paper_id": "source", "page": "doc_id", "text": "text"}
DOCS_BY_SOURCE_SQL = "SELECT source AS paper_id, doc_id AS page, text FROM documents"


@query("b1_repeated_lines", f"WITH {edges_sql(MANUSCRIPT_SQL, 'greatest(3, n // 2)')} SELECT * FROM noise")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.repeated_lines(manuscripts(spark, d))


@query("b1_repeated_lines_by_count", f"WITH {edges_sql(DOCS_BY_SOURCE_SQL, '3')} SELECT * FROM noise")
def repeated_lines_by_count(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.repeated_lines(derive(spark, d, "documents", DOCS_BY_SOURCE, wide=True), ratio=None)


@query("b2_drop_noise", f"WITH {edges_sql(MANUSCRIPT_SQL, 'greatest(3, n // 2)')} {dropped_sql()}")
def drop_noise(spark: SparkSession, d: str) -> DataFrame:
    pages = manuscripts(spark, d)
    return cleaning.drop_noise(pages, cleaning.repeated_lines(pages))


@query("b2_drop_noise_by_count", f"WITH {edges_sql(DOCS_BY_SOURCE_SQL, '3')} {dropped_sql()}")
def drop_noise_by_count(spark: SparkSession, d: str) -> DataFrame:
    pages = derive(spark, d, "documents", DOCS_BY_SOURCE, wide=True)
    return cleaning.drop_noise(pages, cleaning.repeated_lines(pages, ratio=None), bounded=False)


# Normalised text of the given documents, which hold no formula.
NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'),
  '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


@query("b3_normalize_text", f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", mathtext.normalize_text(F.col("text")).alias("text"))


MATH_LINE = {
    "kind": "l_returnflag",
    "line": """CASE l_returnflag WHEN 'A' THEN concat('  L(θ) = ∑ ', l_partkey, ' + x&y (', l_linenumber, ')')
      WHEN 'R' THEN concat('β', l_linenumber, ' ≤ ', CAST(l_quantity AS BIGINT)) ELSE concat('where θ ∈ ℝ of order ', l_orderkey, ' is large and γ', l_linenumber, ' = 3') END""",
    "n": "CAST(l_linenumber AS BIGINT)", "part": "l_partkey", "quantity": "CAST(l_quantity AS BIGINT)", "paper_id": "l_orderkey",
}
MATH_SQL = "src AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MATH_LINE.items()) + " FROM lineitem)"
LATEX_A = r"concat('L(\theta ) = \sum ', part, ' + x\&y')"
LATEX_R = r"concat('\beta_{', n, '} \le ', quantity)"


@query("b4_is_display_equation", f"WITH {MATH_SQL} SELECT paper_id, line, kind <> 'N' AS is_equation FROM src")
def is_display_equation(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "lineitem", MATH_LINE, wide=True).select("paper_id", "line", mathtext.is_display_equation(F.col("line")).alias("is_equation"))


@query(
    "b5_equation_inventory",
    f"""WITH {MATH_SQL} SELECT paper_id, line, CASE kind WHEN 'A' THEN CAST(n AS VARCHAR) END AS equation_no,
  CASE kind WHEN 'A' THEN {LATEX_A} ELSE {LATEX_R} END AS latex FROM src WHERE kind <> 'N'""",
)
def equation_inventory(spark: SparkSession, d: str) -> DataFrame:
    _, found = cleaning.normalize_math(derive(spark, d, "lineitem", MATH_LINE, wide=True))
    return found.select("paper_id", "line", "equation_no", "latex")


@query(
    "b5_normalize_math",
    rf"""WITH {MATH_SQL} SELECT paper_id, CASE kind WHEN 'A' THEN concat('$$ ', {LATEX_A}, ' \tag{{', n, '}} $$')
  WHEN 'R' THEN concat('$$ ', {LATEX_R}, ' $$')
  ELSE concat('where $\theta \in \mathbb{{R}}$ of order ', paper_id, ' is large and $\gamma_{{', n, '}}$ = 3') END AS line FROM src""",
)
def normalize_math(spark: SparkSession, d: str) -> DataFrame:
    lines, _ = cleaning.normalize_math(derive(spark, d, "lineitem", MATH_LINE, wide=True))
    return lines.select("paper_id", "line")


@query(
    "b6_detect_heading",
    f"WITH src AS ({MANUSCRIPT_SQL}), l AS (SELECT paper_id, page, unnest(string_split(text, chr(10))) AS line FROM src) "
    f"SELECT paper_id, page, line, {heading_sql('line')} AS heading FROM l",
)
def detect_heading(spark: SparkSession, d: str) -> DataFrame:
    lines = manuscripts(spark, d).select("paper_id", "page", F.explode(T.lines_of(F.col("text"))).alias("line"))
    return lines.withColumn("heading", T.detect_heading(F.col("line")))


HEADS_SQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {heading_sql('x')}), lambda x: x IS NOT NULL)"


@query(
    "b7_assign_sections",
    f"""WITH src AS ({MANUSCRIPT_SQL}), h AS (SELECT paper_id, page, {HEADS_SQL}[-1] AS last FROM src)
SELECT paper_id, page, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Front Matter') AS section FROM h""",
)
def assign_sections(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.assign_sections(manuscripts(spark, d)).drop("text")


@query("b8_count_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens FROM documents")
def count_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


def chunks_sql(size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, source: str = "pages") -> str:
    """Tables c1..c5 cut the pieces of the source that are too large by one separator each; `ch` has the chunks.

    A fold keeps the open chunk as a list of pieces; a full one is closed, and of its pieces the longest
    tail that is small enough opens the next.
    """
    tokens = "((length({}) + 3) // 4)".format
    strip = ("trim({}, '" + T.SPACES + "')").format
    closed = f"list_append(a.o, {{'t': {strip('array_to_string(a.h, chr(0))')}, 'big': false}})".replace("chr(0)", "''")
    total = f"coalesce(list_sum(list_transform({{}}, lambda y: {tokens('y')})), 0)".format
    room = f"least({overlap}, {size} - {tokens('x')})"
    first = f"list_filter(range(1, len(a.h) + 2), lambda j: {total('a.h[j:]')} <= {room})[1]"
    kinds = "STRUCT(t VARCHAR, big BOOLEAN)[]"
    step = f"""CASE WHEN {tokens('x')} > {size} THEN {{'o': list_append(CASE WHEN len(a.h) > 0 THEN {closed} ELSE a.o END, {{'t': x, 'big': true}}), 'h': CAST([] AS VARCHAR[])}}
      WHEN len(a.h) > 0 AND {total('a.h')} + {tokens('x')} > {size} THEN {{'o': {closed}, 'h': list_append(a.h[{first}:], x)}}
      ELSE {{'o': a.o, 'h': list_append(a.h, x)}} END"""
    out = [f"c0 AS (SELECT paper_id, page, [{{'t': {strip('text')}, 'big': {tokens(strip('text'))} > {size}}}] AS ps FROM {source})"]
    for n, separator in enumerate(chunking.SEPARATORS):
        sep = "'" + separator + "'"
        cut = (
            f"list_transform(string_split(p.t, {sep}), lambda y, i: CASE WHEN i < len(string_split(p.t, {sep})) THEN y || {sep} ELSE y END)"
            if separator
            else f"list_transform(range(0, length(p.t), {4 * size}), lambda i: substr(p.t, i + 1, {4 * size}))"
        )
        fold = f"list_reduce({cut}, lambda a, x: {step}, {{'o': CAST([] AS {kinds}), 'h': CAST([] AS VARCHAR[])}})"
        rows = f"SELECT paper_id, page, p, i FROM (SELECT paper_id, page, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM c{n})"
        made = f"SELECT *, CASE WHEN p.big AND contains(p.t, {sep}) THEN {fold} END AS a FROM ({rows})"
        pieces = f"CASE WHEN a IS NULL THEN [p] WHEN len(a.h) > 0 THEN {closed} ELSE a.o END"
        out.append(f"c{n + 1} AS (SELECT paper_id, page, flatten(list({pieces} ORDER BY i)) AS ps FROM ({made}) GROUP BY 1, 2)")
    last = len(chunking.SEPARATORS)
    out.append(f"""ch AS (SELECT paper_id, page, CAST(i - 1 AS INTEGER) AS pos, cs[i] AS text FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM
  (SELECT paper_id, page, list_filter(list_transform(ps, lambda p: p.t), lambda t: {strip('t')} <> '') AS cs FROM c{last})))""")
    return ",\n".join(out)


@query("b9_chunk_pages", f"WITH {doc_pages_sql(20)}, {chunks_sql()} SELECT * FROM ch")
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    chunked = chunking.chunk_pages(doc_pages(spark, d, 20))
    return chunked.select("paper_id", "page", F.posexplode("chunks").alias("pos", "text"))


@query(
    "b9b_hard_split",
    """SELECT doc_id, CAST(i AS BIGINT) AS pos, substr(text, i * 1600 + 1, 1600) AS piece FROM
  (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 1600)) AS i FROM documents WHERE length(text) > 0)""",
)
def hard_split(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(T.hard_split(F.col("text"), 400)).alias("pos", "piece")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(
    "b10_label_chunks",
    f"""WITH src AS ({MANUSCRIPT_SQL}),
c AS (SELECT paper_id, page, i AS pos, ls[i] AS text FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM src)),
h AS (SELECT *, {heading_sql("text")} AS heading FROM c)
SELECT paper_id, row_number() OVER w - 1 AS chunk_index, page, text,
  coalesce(last_value(heading IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Front Matter') AS section
FROM h WINDOW w AS (PARTITION BY paper_id ORDER BY page, pos)""",
)
def label_chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = manuscripts(spark, d).withColumn("chunks", T.lines_of(F.col("text")))
    return chunking.label_chunks(lines)


LABELLED_SQL = f"""{chunks_sql()},
lines AS (SELECT paper_id, page, pos, i, {heading_sql("line")} AS heading FROM
  (SELECT paper_id, page, pos, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ch)),
heads AS (SELECT paper_id, page, pos, first(heading ORDER BY i) AS head, last(heading ORDER BY i) AS tail FROM lines WHERE heading IS NOT NULL GROUP BY 1, 2, 3),
page_lines AS (SELECT paper_id, page, i, {heading_sql("line")} AS heading FROM
  (SELECT paper_id, page, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pages)),
page_heads AS (SELECT paper_id, page, last(heading ORDER BY i) AS tail FROM page_lines WHERE heading IS NOT NULL GROUP BY 1, 2),
starts AS (SELECT paper_id, page, last_value(tail IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
  FROM pages LEFT JOIN page_heads USING (paper_id, page)),
labelled AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page, pos) - 1 AS chunk_index, page, regexp_replace(text, '\n{{2,}}', chr(10) || chr(10), 'g') AS text,
  coalesce(head, last_value(tail IGNORE NULLS) OVER (PARTITION BY paper_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start, 'Front Matter') AS section
  FROM ch LEFT JOIN heads USING (paper_id, page, pos) JOIN starts USING (paper_id, page))"""


@query("b10_chunk_papers", f"WITH {doc_pages_sql(20)}, {LABELLED_SQL} SELECT * FROM labelled")
def chunk_papers(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_papers(doc_pages(spark, d, 20))


SPANS = {
    "paper_id": "l_orderkey", "page": "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 2 ELSE 1 END",
    "seq": "CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey", "size": "floor(l_quantity / 4) / 2", "text": "concat(' part ', l_partkey, ' ')",
}
TITLED = {
    "paper_id": "o_orderkey", "file_name": "concat('order', o_orderkey, '.v1.pdf')",
    "meta_title": "CASE o_orderstatus WHEN 'F' THEN concat('Microsoft Word - ', o_orderkey) WHEN 'O' THEN concat(' Order titled ', o_orderkey, ' ') ELSE 'abc' END",
}
FIRST_LINE = {"paper_id": "o_orderkey", "text": "CASE WHEN o_orderpriority = '5-LOW' THEN 'x' ELSE concat('ab', chr(10), ' First line ', o_orderpriority, chr(10), 'Second line') END"}


def _select(fields: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in fields.items()) + f" FROM {source}"


@query(
    "b11_elect_title",
    f"""WITH s AS ({_select(SPANS, "lineitem")}), p AS ({_select(TITLED, "orders")}), f AS ({_select(FIRST_LINE, "orders")}),
big AS (SELECT paper_id, seq, trim(text) AS text, size, max(size) OVER (PARTITION BY paper_id) AS m FROM s WHERE page = 1),
t AS (SELECT paper_id, string_agg(text, ' ' ORDER BY seq, text) AS t FROM big WHERE size >= m - 0.5 GROUP BY 1),
l AS (SELECT paper_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 5 AND length(x) < 200)[1] AS l FROM f)
SELECT paper_id, coalesce(CASE WHEN length(trim(meta_title)) > 5 AND NOT starts_with(lower(trim(meta_title)), 'microsoft word') THEN trim(meta_title) END,
  CASE WHEN length(t) > 5 AND length(t) < 250 THEN t END, l, regexp_replace(file_name, '\\.[^.]*$', '')) AS title
FROM p LEFT JOIN t USING (paper_id) LEFT JOIN l USING (paper_id)""",
)
def elect_title(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.elect_title(
        derive(spark, d, "orders", TITLED), derive(spark, d, "lineitem", SPANS), derive(spark, d, "orders", FIRST_LINE)
    )


FRONT = [
    {
        "paper_id": "o_orderkey", "page": "CAST(1 AS BIGINT)",
        "text": """concat('Title of ', o_orderkey, chr(10), CASE o_orderstatus WHEN 'F' THEN concat('ABSTRACT. We order  ', o_orderpriority, chr(10), 'for customer ', o_custkey, '.', chr(10))
          WHEN 'O' THEN concat('No summary', chr(10)) ELSE 'Abstract: starts here' END)""",
    },
    {
        "paper_id": "o_orderkey", "page": "CAST(2 AS BIGINT)",
        "text": "concat('and goes on ', o_custkey, chr(10), CASE WHEN o_orderpriority = '5-LOW' THEN ' 1. Introduction' ELSE 'Keywords' END, chr(10), 'Body')",
    },
    {"paper_id": "o_orderkey", "page": "CAST(3 AS BIGINT)", "text": "concat('Abstract nonsense ', o_custkey, chr(10), 'Introduction')"},
]


@query(
    "b12_extract_abstract",
    "WITH f AS (" + " UNION ALL ".join(_select(x, "orders") for x in FRONT) + r""")
, t AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY page) AS text FROM f WHERE page <= 2 GROUP BY 1)
SELECT paper_id, left(trim(regexp_replace(regexp_extract(text, '(?is)\babstract\b[\s.:\-—]*(.+?)\n\s*(?:\d{1,2}\.?\s*|I\.\s*)?(?:introduction|keywords|index terms)\b', 1), '\s+', ' ', 'g')), 3000) AS abstract FROM t""",
)
def extract_abstract(spark: SparkSession, d: str) -> DataFrame:
    pages = [derive(spark, d, "orders", x) for x in FRONT]
    return cleaning.extract_abstract(pages[0].unionByName(pages[1]).unionByName(pages[2]))


@query(
    "b13_full_text",
    f"WITH {doc_pages_sql(20)} SELECT paper_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY 1",
)
def full_text(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.full_text(doc_pages(spark, d, 20))
