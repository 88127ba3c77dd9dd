"""Running headers, page clean-up, sections, titles, abstracts, full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import mathtext, text as T
from quire.functions.bind import let
from quire.operators.scan import carry


def edge_lines(text: Column, head: int = 3, tail: int = 3) -> Column:
    """Distinct trimmed non-blank lines at the top and the bottom of a page."""
    lines = F.filter(F.transform(T.lines_of(text), T.strip), lambda x: x != "")
    return let(lines, lambda x: F.array_distinct(F.concat(F.slice(x, 1, head), F.slice(F.reverse(x), 1, tail))))


def repeated_lines(
    pages: DataFrame, head: int = 3, tail: int = 3, min_pages: int = 3, min_count: int = 3, ratio: int | None = 2
) -> DataFrame:
    """Lines found at the edge of at least max(min_count, pages // ratio) pages of a paper.

    Both counts combine on the map side, so a paper with very many pages is no hot spot.
    """
    edges = pages.select("paper_id", F.explode(edge_lines(F.col("text"), head, tail)).alias("line"))
    counted = edges.groupBy("paper_id", "line").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_count)
    sizes = pages.groupBy("paper_id").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= min_pages)
    found = counted.join(sizes, "paper_id")
    if ratio is not None:
        found = found.filter(F.col("n_pages") >= F.floor(F.col("_pages") / ratio))
    return found.select("paper_id", "line", "n_pages")


def _kept(lines: Column, noise: Column) -> Column:
    def keep(trimmed: Column) -> Column:
        return ~F.coalesce(F.array_contains(noise, trimmed), F.lit(False)) & ~trimmed.rlike(T.PAGE_NUMBER)

    return F.array_join(F.filter(lines, lambda line: let(T.strip(line), keep)), "\n")


def drop_noise(pages: DataFrame, noise: DataFrame, bounded: bool = True) -> DataFrame:
    """Remove noise lines and bare page numbers from every page.

    With the default thresholds a paper has at most (head + tail) * ratio noise lines, so they fit in
    one array per paper and pages are never taken apart. For rules without that bound, pass
    `bounded=False`: lines are then matched by a join on (paper, line).
    """
    if bounded:
        per_paper = noise.groupBy("paper_id").agg(F.collect_set("line").alias("_noise"))
        return (
            pages.join(per_paper, "paper_id", "left")
            .withColumn("text", _kept(T.lines_of(F.col("text")), F.col("_noise")))
            .select(*pages.columns)
        )
    # Only lines that are noise anywhere on the page travel; each page gets its own short list back.
    own = pages.select("paper_id", "page", F.explode(F.array_distinct(F.transform(T.lines_of(F.col("text")), T.strip))).alias("line"))
    hits = own.join(noise.select("paper_id", "line"), ["paper_id", "line"], "left_semi")
    per_page = hits.groupBy("paper_id", "page").agg(F.collect_set("line").alias("_noise"))
    return (
        pages.join(per_page, ["paper_id", "page"], "left")
        .withColumn("text", _kept(T.lines_of(F.col("text")), F.col("_noise")))
        .select(*pages.columns)
    )


def normalize_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", mathtext.normalize_text(F.col("text")))


def clean_pages(pages: DataFrame, noise: DataFrame | None = None, **rules) -> DataFrame:
    """Noise comes from the raw pages, is dropped first, and only then is the text normalised."""
    bounded = rules.get("ratio", 2) is not None
    noise = repeated_lines(pages, **rules) if noise is None else noise
    return normalize_pages(drop_noise(pages, noise, bounded))


def normalize_math(lines: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(lines with LaTeX, inventory of display equations with number and LaTeX)."""
    source = F.col(column)
    equations = lines.filter(mathtext.is_display_equation(source)).withColumns(
        {"equation_no": mathtext.equation_number(source), "latex": mathtext.equation_latex(source)}
    )
    return lines.withColumn(column, mathtext.normalize_math(source)), equations


def assign_sections(pages: DataFrame, default: str = T.FRONT_MATTER, **rules) -> DataFrame:
    """Section in effect at the start of each page: the last heading of any page before it."""
    marked = pages.withColumn("_last", F.try_element_at(T.headings_of(F.col("text"), **rules), F.lit(-1)))
    out = carry(marked, ["paper_id"], "page", lasts={"_section": "_last"})
    return out.withColumn("section", F.coalesce("_section", F.lit(default))).select(*pages.columns, "section")


def elect_title(papers: DataFrame, spans: DataFrame, first_lines: DataFrame) -> DataFrame:
    """Title per paper: usable metadata, else the largest type on page one, else the first fitting line, else the file stem.

    papers(paper_id, meta_title, file_name), spans(paper_id, page, seq, size, text),
    first_lines(paper_id, text): the text of page one.
    """
    meta = T.strip(F.coalesce("meta_title", F.lit("")))
    from_meta = F.when(
        (F.length(meta) > 5) & ~F.startswith(F.lower(meta), F.lit("microsoft word")) & ~F.startswith(F.lower(meta), F.lit("untitled")), meta
    )
    usable = spans.filter(F.col("page") == 1).withColumn("text", T.strip(F.col("text"))).filter(F.col("text") != "")
    largest = usable.groupBy("paper_id").agg(F.max("size").alias("_max"))
    big = usable.join(largest, "paper_id").filter(F.col("size") >= F.col("_max") - 0.5)
    # Lengths are added up before anything is collected: only titles below 250 characters are put together.
    fitting = big.groupBy("paper_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("_len")).filter("_len > 5 and _len < 250")
    from_type = big.join(fitting, "paper_id", "left_semi").groupBy("paper_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("_type")
    )
    lines = F.filter(F.transform(T.lines_of(F.col("text")), T.strip), lambda x: F.length(x).between(6, 199))
    from_line = first_lines.select("paper_id", F.try_element_at(lines, F.lit(1)).alias("_line"))
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*\z", "")
    return (
        papers.withColumn("_meta", from_meta)
        .join(from_type, "paper_id", "left")
        .join(from_line, "paper_id", "left")
        .select("paper_id", F.coalesce("_meta", "_type", "_line", stem).alias("title"))
    )


def extract_abstract(pages: DataFrame, limit: int = T.MAX_ABSTRACT) -> DataFrame:
    """Abstract from the first two pages; an empty string when there is none."""
    front = pages.filter(F.col("page").isin(1, 2)).groupBy("paper_id").agg(
        F.max(F.when(F.col("page") == 1, F.col("text"))).alias("_one"),
        F.max(F.when(F.col("page") == 2, F.col("text"))).alias("_two"),
    )
    body = F.regexp_extract(F.concat_ws("\n", "_one", "_two"), T.ABSTRACT, 1)
    return front.select("paper_id", F.left(T.squeeze(body), F.lit(limit)).alias("abstract"))


def full_text(pages: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """Text of a paper in page order, one row per paper. Admission bounds a paper's size."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), joiner).alias("text"))


def full_text_parts(pages: DataFrame, pages_per_part: int = 1024, joiner: str = "\n\n") -> DataFrame:
    """The same in parts of bounded size; joining a paper's parts by `joiner` gives its whole text."""
    cut = pages.withColumn("part", F.floor((F.col("page") - 1) / pages_per_part).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return cut.groupBy("paper_id", "part").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), joiner).alias("text"))
