"""Raw grids to clean tables: cells, headers, plausibility, Markdown, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.bind import let
from quire.functions.text import squeeze
from quire.operators.scan import first_rows

# Limits of a table.
MAX_CELL = 200
MAX_CAPTION = 300
MAX_TABLES = 60
MIN_FILL = 0.35
MAX_MEAN_CELL = 60
MAX_SEARCH_TEXT = 2000
EMPTY_GRID = "array<array<string>>"


def _filled(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: c != ""))


def clean_matrix(raw: Column) -> Column:
    """Tidy cells, pad ragged rows, drop rows and columns that are empty throughout."""
    cell = lambda c: F.left(F.coalesce(squeeze(c), F.lit("")), F.lit(MAX_CELL))
    rows = F.transform(F.filter(raw, lambda r: F.coalesce(F.size(r), F.lit(0)) > 0), lambda r: F.transform(r, cell))

    def pad(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        return let(width, lambda w: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))

    def drop_columns(solid: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(F.element_at(solid, 1)), F.lit(1)))
        used = F.filter(places, lambda j: F.exists(solid, lambda r: F.element_at(r, j) != ""))
        kept = let(used, lambda u: F.transform(solid, lambda r: F.transform(u, lambda j: F.element_at(r, j))))
        return F.when(F.size(solid) > 0, kept).otherwise(F.array().cast(EMPTY_GRID))

    solid = F.filter(let(rows, pad), lambda r: _filled(r) > 0)
    return let(solid, drop_columns)


def split_header(matrix: Column) -> Column:
    """struct(headers, rows). A sparse group header is filled to the right and joined with the row below."""

    def names(top: Column, second: Column, merged: Column) -> Column:
        carried = F.transform(
            top, lambda _, i: F.coalesce(
                F.try_element_at(F.filter(F.slice(top, F.lit(1), i + 1), lambda c: c != ""), F.lit(-1)), F.lit("")
            )
        )
        joined = F.zip_with(
            carried, second, lambda t, s: F.when((t != "") & (t != s), F.trim(F.concat(t, F.lit(" "), s))).when(s != "", s).otherwise(t)
        )
        plain = F.when(merged, joined).otherwise(top)
        return F.transform(plain, lambda h, i: F.when(h != "", h).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string"))))

    def split(m: Column) -> Column:
        first, second = F.element_at(m, 1), F.try_element_at(m, F.lit(2))
        filled = _filled(first)
        merged = F.coalesce((F.size(first) > 2) & (filled <= F.size(first) / 2) & (_filled(second) > filled), F.lit(False))
        headers = let(F.struct(first.alias("top"), second.alias("second"), merged.alias("merged")), lambda x: names(x["top"], x["second"], x["merged"]))
        return F.struct(headers.alias("headers"), F.slice(m, F.when(merged, F.lit(3)).otherwise(F.lit(2)), F.size(m)).alias("rows"))

    return let(matrix, split)


def plausible(headers: Column, rows: Column) -> Column:
    """At least two columns and one row, well filled, with short cells."""

    def dense(cells: Column) -> Column:
        full = F.filter(cells, lambda c: c != "")
        length = F.aggregate(full, F.lit(0).cast("bigint"), lambda a, c: a + F.length(c))
        fill = F.size(full) / F.greatest(F.size(cells), F.lit(1))
        return (fill >= MIN_FILL) & (length / F.greatest(F.size(full), F.lit(1)) <= MAX_MEAN_CELL)

    return (F.size(headers) >= 2) & (F.size(rows) >= 1) & let(F.flatten(rows), dense)


def _md_row(cells: Column) -> Column:
    escaped = F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def to_markdown(headers: Column, rows: Column) -> Column:
    rule = _md_row(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(_md_row(headers), rule), F.transform(rows, _md_row)), "\n")


def search_text(caption: Column, headers: Column, rows: Column, limit: int = MAX_SEARCH_TEXT) -> Column:
    """What a table is embedded as."""
    full = lambda cells: F.filter(cells, lambda c: c != "")
    body = F.array_join(F.transform(rows, lambda r: F.array_join(full(r), " | ")), "; ")
    return F.left(
        F.concat(caption, F.lit(": Columns ["), F.array_join(full(headers), ", "), F.lit("]. Rows: "), body), F.lit(limit)
    )


def build_tables(grids: DataFrame) -> DataFrame:
    """grids(paper_id, page, x0, top, x1, bottom, caption, matrix) to plausible tables with headers and rows."""
    def table(m: Column) -> Column:
        def judge(t: Column) -> Column:
            return F.when(plausible(t["headers"], t["rows"]), t)

        return F.when(F.size(m) >= 2, let(split_header(m), judge))

    made = grids.withColumn("_t", let(clean_matrix(F.col("matrix")), table)).drop("matrix")
    # A row per grid that made a table; exploding evaluates the grid once.
    kept = made.withColumn("_t", F.explode(F.array_compact(F.array("_t"))))
    return kept.withColumns({"headers": F.col("_t.headers"), "rows": F.col("_t.rows")}).drop("_t")


def number_tables(tables: DataFrame, cap: int = MAX_TABLES) -> DataFrame:
    """Number a paper's tables in reading order; the first `cap` are kept, as the product rule says."""
    order = [F.col(c) for c in ("page", "top", "x0", "x1", "bottom", "caption")]
    ranked = first_rows(tables, ["paper_id"], order, cap, "table_index")
    fallback = F.concat(F.lit("Table "), F.col("table_index").cast("string"), F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))
    return ranked.withColumns(
        {
            "table_index": F.col("table_index").cast("bigint"),
            "caption": F.left(F.coalesce(F.when(F.col("caption") != "", F.col("caption")), fallback), F.lit(MAX_CAPTION)),
            "bbox": F.array(*[F.round(c, 1) for c in ("x0", "top", "x1", "bottom")]),
        }
    ).drop("x0", "top", "x1", "bottom")


def extract_tables(grids: DataFrame, cap: int = MAX_TABLES) -> DataFrame:
    """Raw grids to numbered tables with Markdown and search text."""
    return number_tables(build_tables(grids), cap).withColumns(
        {
            "markdown": to_markdown(F.col("headers"), F.col("rows")),
            "search_text": search_text(F.col("caption"), F.col("headers"), F.col("rows")),
        }
    )
