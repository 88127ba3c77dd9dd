"""Cell-level citations in answers, and the table cells they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quote characters and the forms of a cell citation and of a caption number.
_OPEN, _CLOSE = "[\"“'‘]", "[\"”'’]"
_LABEL = "([^\"”'’]+)"
CELL_REF = rf"(?i)Table\s*(\d+|[IVX]+)\s*,\s*row\s*{_OPEN}{_LABEL}{_CLOSE}\s*,\s*col(?:umn)?\s*{_OPEN}{_LABEL}{_CLOSE}"
CAPTION_NUMBER = r"^(?:Table|TABLE|Tab\.)\s*(\d+|[IVX]+)"


def cell_key(c: Column) -> Column:
    """Comparison form of a label: lower case, Markdown marks and white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s*_`]+", " "))


def caption_number(caption: Column) -> Column:
    n = F.regexp_extract(F.coalesce(caption, F.lit("")), CAPTION_NUMBER, 1)
    return F.when(n != "", n)


def cell_references(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row per cited cell: ref_no, table_no, row_label, col_label."""
    group = lambda g: F.regexp_extract_all(F.col(column), F.lit(CELL_REF), g)
    zipped = F.arrays_zip(group(1).alias("t"), group(2).alias("r"), group(3).alias("c"))
    rows = answers.select(*[c for c in answers.columns if c != column], F.posexplode(zipped).alias("_at", "_m"))
    return rows.select(
        "*", (F.col("_at") + 1).cast("bigint").alias("ref_no"), F.col("_m.t").alias("table_no"),
        cell_key(F.col("_m.r")).alias("row_label"), cell_key(F.col("_m.c")).alias("col_label"),
    ).drop("_at", "_m")


def _hits(keys: Column, label: Column) -> Column:
    """Positions whose key is equal to a label, or contains a label of two characters or more."""
    found = F.filter(
        F.transform(keys, lambda k, i: F.struct(i.alias("i"), k.alias("k"))),
        lambda p: (p["k"] == label) | ((F.length(label) > 1) & F.contains(p["k"], label)),
    )
    return F.transform(found, lambda p: p["i"].cast("bigint"))


def resolve_cells(refs: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells each reference hits, references that hit none).

    A reference names a table by its index or by the number in its caption, within its paper. Labels are
    brought to their comparison form once per table, and each distinct pair of labels meets each distinct
    grid of the tables it may mean once; what they hit is then handed to all their references and tables.
    """
    names = F.array_distinct(F.array_compact(F.array(F.col("table_index").cast("string"), caption_number(F.col("caption")))))
    keyed = tables.select(
        "paper_id", "table_index", names.alias("_names"), F.transform("headers", cell_key).alias("_heads"),
        F.transform("rows", lambda r: cell_key(F.try_element_at(r, F.lit(1)))).alias("_rows"),
    )
    grid = F.sha2(F.to_json(F.struct("_heads", "_rows")), 256)
    named = keyed.withColumn("_grid", grid).withColumn("table_no", F.explode("_names"))
    place, labels = ["paper_id", "table_no"], ["paper_id", "table_no", "row_label", "col_label"]
    grids = named.select(*place, "_grid", "_heads", "_rows").dropDuplicates([*place, "_grid"])
    asked = refs.select(*labels).distinct()
    met = asked.join(grids, place).select(
        *labels, "_grid", _hits(F.col("_rows"), F.col("row_label")).alias("_r"), _hits(F.col("_heads"), F.col("col_label")).alias("_c")
    )
    met = met.filter((F.size("_r") > 0) & (F.size("_c") > 0))
    places = met.join(named.select(*place, "_grid", "table_index"), [*place, "_grid"]).select(*labels, "table_index", "_r", "_c")
    places = places.withColumn("row_no", F.explode("_r")).withColumn("col_no", F.explode("_c")).drop("_r", "_c")
    rest = [c for c in refs.columns if c not in place]
    cells = refs.join(places, labels).select(*place, *rest, "table_index", "row_no", "col_no")
    keys = [c for c in refs.columns if c not in ("table_no", "row_label", "col_label")]
    hit = refs.join(met.select(*labels), labels, "left_semi").select(*keys).distinct()
    return cells, refs.join(hit, keys, "left_anti")
