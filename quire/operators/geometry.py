"""Page geometry to table regions and word grids.

Inputs are positioned lines, rules (edges) and words of pages. Where the result depends on the order
in which items are met, an array of one page's items is folded; such arrays are bounded by what fits
on a printed page. Everything that can be pre-aggregated (word positions) is, before it is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.bind import let
from quire.functions.text import strip

PAGE = ["paper_id", "page"]

# Caption forms, and distances in points.
CAPTION = (
    r"^\s*(?:(?:Table|Tab\.)\s*(?:[0-9]{1,2}|[IVX]{1,5})\s*(?:[:.|]|\z)"
    r"|TABLE\s*(?:[0-9]{1,2}|[IVX]{1,5})(?![A-Za-z0-9]))"
)
TITLE_GAP = 8.0
ABOVE_GAP = 60.0
BELOW_GAP = 40.0
RULE_SHARE = 0.25
RULE_MERGE = 2.0
RULE_REACH = 50.0
RULE_GAP = 30.0
GROUP_GAP = 200.0
MIN_HEIGHT = 12.0
ROW_TOLERANCE = 3.0
COLUMN_GAP = 7.0


def caption_lines(text_lines: DataFrame) -> DataFrame:
    """Lines that open a table caption; a bare "TABLE IV" takes the title line right below it.

    text_lines(paper_id, page, line_no, x0, x1, top, bottom, text)
    """
    after = Window.partitionBy(*PAGE).orderBy("line_no")
    here = F.struct("text", "top", "bottom", "x0", "x1")
    lines = text_lines.withColumn("_next", F.lead(here).over(after))
    mark = F.regexp_extract("text", CAPTION, 0)
    own = strip(F.col("text"))
    takes_next = (
        (F.length(own) <= F.length(mark) + 1)
        & F.col("_next").isNotNull()
        & (F.col("_next.top") - F.col("bottom")).between(0, TITLE_GAP)
    )
    return lines.filter(F.col("text").rlike(CAPTION)).select(
        *PAGE,
        "line_no",
        F.when(takes_next, F.concat(own, F.lit(": "), strip(F.col("_next.text")))).otherwise(own).alias("text"),
        F.when(takes_next, F.least("x0", "_next.x0")).otherwise(F.col("x0")).alias("x0"),
        F.when(takes_next, F.greatest("x1", "_next.x1")).otherwise(F.col("x1")).alias("x1"),
        "top",
        F.when(takes_next, F.col("_next.bottom")).otherwise(F.col("bottom")).alias("bottom"),
    )


def _page_captions(captions: DataFrame) -> DataFrame:
    """Captions of a page in reading order, as one array. Copies of a caption line count once."""
    item = F.struct("line_no", "text", "x0", "x1", "top", "bottom")
    return captions.groupBy(*PAGE).agg(F.array_sort(F.collect_set(item)).alias("_captions"))


def caption_gap(cap: Column, x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """Distance of a caption above (first choice) or below a box, or null when it is not near."""
    above = top - cap["bottom"]
    below = cap["top"] - bottom
    near = F.when(above.between(0, ABOVE_GAP), above).when(below.between(0, BELOW_GAP), below)
    return F.when((cap["x0"] < x1) & (cap["x1"] > x0), near)


def nearest_caption(boxes: DataFrame, captions: DataFrame) -> DataFrame:
    """Add the caption nearest to each box; boxes without one keep null. The first wins on ties."""
    def candidate(cap: Column) -> Column:
        gap = caption_gap(cap, F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"))
        return F.struct(gap.alias("gap"), cap["line_no"].alias("line_no"), cap["text"].alias("text"))

    near = F.filter(F.transform("_captions", candidate), lambda c: c["gap"].isNotNull())
    return (
        boxes.join(_page_captions(captions), PAGE, "left")
        .withColumn("caption", F.array_min(near)["text"])
        .drop("_captions")
    )


def cluster_rules(edges: DataFrame, page_dims: DataFrame) -> DataFrame:
    """Wide horizontal edges, merged in drawing order into the first rule within two points.

    edges(paper_id, page, seq, orientation, x0, x1, top, bottom), page_dims(paper_id, page, width, height)
    """
    wide = (
        edges.filter(F.col("orientation") == "h")
        .join(page_dims.select(*PAGE, "width"), PAGE)
        .filter(F.col("x1") - F.col("x0") >= F.col("width") * RULE_SHARE)
        .select(*PAGE, "seq", ((F.col("top") + F.col("bottom")) / 2).alias("y"), "x0", "x1")
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "y", "x0", "x1")))

    def merge(rules: Column, edge: Column) -> Column:
        fits = F.transform(
            rules, lambda r: (F.abs(r["y"] - edge["y"]) <= RULE_MERGE) & (r["x0"] < edge["x1"]) & (r["x1"] > edge["x0"])
        )
        at = F.array_position(fits, True)
        grown = F.transform(
            rules,
            lambda r, i: F.when(
                i + 1 == at,
                F.struct(r["y"].alias("y"), F.least(r["x0"], edge["x0"]).alias("x0"), F.greatest(r["x1"], edge["x1"]).alias("x1")),
            ).otherwise(r),
        )
        new = F.array(F.struct(edge["y"].alias("y"), edge["x0"].alias("x0"), edge["x1"].alias("x1")))
        return F.when(at > 0, grown).otherwise(F.concat(rules, new))

    none = F.array().cast("array<struct<y:double,x0:double,x1:double>>")
    folded = wide.groupBy(*PAGE).agg(F.aggregate(ordered, none, merge).alias("_rules"))
    return folded.select(*PAGE, F.inline("_rules"))


def booktabs_regions(captions: DataFrame, rules: DataFrame, page_dims: DataFrame) -> DataFrame:
    """For each caption, the box of the rule group right below or above it, if there is one.

    A group stops at the next caption and at a gap of more than 200 points.
    """
    page_rules = rules.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("_rules"))
    cap = captions.join(_page_captions(captions), PAGE).join(page_rules, PAGE).join(page_dims, PAGE)
    near = F.filter(
        "_rules", lambda r: (r["x0"] < F.col("x1") + RULE_REACH) & (r["x1"] > F.col("x0") - RULE_REACH)
    )
    following = F.transform(F.filter("_captions", lambda c: c["top"] > F.col("bottom")), lambda c: c["top"])
    preceding = F.transform(F.filter("_captions", lambda c: c["bottom"] < F.col("top")), lambda c: c["bottom"])
    cap = cap.withColumns(
        {
            "_near": near,
            "_floor": F.coalesce(F.array_min(following), F.col("height")),
            "_roof": F.coalesce(F.array_max(preceding), F.lit(0.0)),
        }
    )
    below = F.filter("_near", lambda r: (r["y"] > F.col("bottom") - 1) & (r["y"] < F.col("_floor")))
    above = F.reverse(F.filter("_near", lambda r: (r["y"] > F.col("_roof")) & (r["y"] < F.col("top") + 1)))
    cap = cap.withColumns({"_below": below, "_above": above})
    gap_below = F.try_element_at("_below", F.lit(1))["y"] - F.col("bottom")
    gap_above = F.col("top") - F.try_element_at("_above", F.lit(1))["y"]
    pick_below = (gap_below <= RULE_GAP) & (gap_above.isNull() | (gap_above > RULE_GAP) | (gap_below <= gap_above))
    chosen = F.when(pick_below, F.col("_below")).when(gap_above <= RULE_GAP, F.col("_above"))
    cap = cap.withColumn("_chosen", chosen)
    # The group ends before the first rule that is too far from its predecessor.
    breaks = F.transform(
        "_chosen",
        lambda r, i: (i > 0) & (F.abs(r["y"] - F.element_at(F.col("_chosen"), F.greatest(i, F.lit(1)))["y"]) > GROUP_GAP),
    )
    stop = F.array_position(breaks, True)
    group = F.when(stop > 0, F.slice("_chosen", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("_chosen"))
    cap = cap.withColumn("_group", group).filter(F.size("_group") >= 2)
    pick = lambda field: F.transform("_group", lambda r: r[field])
    return (
        cap.select(
            *PAGE,
            "line_no",
            F.col("text").alias("caption"),
            F.greatest(F.lit(0.0), F.array_min(pick("x0"))).alias("x0"),
            F.greatest(F.lit(0.0), F.array_min(pick("y")) - 1).alias("top"),
            F.least("width", F.array_max(pick("x1"))).alias("x1"),
            F.least("height", F.array_max(pick("y")) + 1).alias("bottom"),
        )
        .filter(F.col("bottom") - F.col("top") >= MIN_HEIGHT)
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["top"] < b["bottom"]) & (a["bottom"] > b["top"])


def drop_overlaps(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates, in caption order, that use a new caption and overlap no box found so far on their page.

    candidates(paper_id, page, line_no, caption, x0, top, x1, bottom), found(paper_id, page, caption, x0, top, x1, bottom)
    """
    shape = "array<struct<x0:double,top:double,x1:double,bottom:double,caption:string,line_no:bigint>>"
    box = lambda line: F.struct("x0", "top", "x1", "bottom", "caption", line.cast("bigint").alias("line_no"))
    taken = found.groupBy(*PAGE).agg(F.collect_set(box(F.lit(None))).alias("_found"))
    waiting = candidates.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("line_no", box(F.col("line_no")).alias("box")))).alias("_queue")
    )

    def admit(kept: Column, item: Column) -> Column:
        clash = F.exists(kept, lambda k: overlaps(item["box"], k) | F.coalesce(k["caption"] == item["box"]["caption"], F.lit(False)))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(item["box"])))

    start = F.coalesce("_found", F.array()).cast(shape)
    folded = waiting.join(taken, PAGE, "left").select(*PAGE, F.explode(F.aggregate("_queue", start, admit)).alias("b"))
    return folded.filter(F.col("b.line_no").isNotNull()).select(
        *PAGE, "b.line_no", "b.caption", "b.x0", "b.top", "b.x1", "b.bottom"
    )


def words_in(words: DataFrame, regions: DataFrame, region: str = "line_no") -> DataFrame:
    """Words whose centre lies inside a region of their page, with the region's key."""
    boxes = regions.groupBy(*PAGE).agg(F.collect_set(F.struct(region, "x0", "top", "x1", "bottom")).alias("_boxes"))
    inside = F.filter(
        "_boxes",
        lambda b: (F.col("x0") < b["x1"]) & (F.col("x1") > b["x0"]) & (F.col("top") >= b["top"]) & (F.col("top") < b["bottom"]),
    )
    placed = words.join(boxes, PAGE).withColumn("_in", F.explode(inside))
    return placed.withColumn(region, F.col(f"_in.{region}")).drop("_boxes", "_in")


def cluster_rows(words: DataFrame, keys: list[str], tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Add `row_no` (from 0): a word joins the row while it is within tolerance of the row's first word.

    Only distinct baselines are folded, after a map-side distinct; a page has few of them, whatever
    the number of words.
    """
    tops = words.select(*keys, "top").distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("top")).alias("_tops"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("anchors"))

    def step(acc: Column, top: Column) -> Column:
        joins = acc["anchor"].isNotNull() & (top - acc["anchor"] <= tolerance)
        return F.when(joins, acc).otherwise(
            F.struct(top.alias("anchor"), F.concat(acc["anchors"], F.array(top)).alias("anchors"))
        )

    anchors = F.aggregate("_tops", start, step)["anchors"]
    rows = tops.select(*keys, anchors.alias("_anchors"))
    number = F.size(F.filter("_anchors", lambda a: a <= F.col("top"))) - 1
    return words.join(rows, keys).withColumn("row_no", number.cast("bigint")).withColumn("n_rows", F.size("_anchors").cast("bigint")).drop("_anchors")


def infer_columns(rowed: DataFrame, keys: list[str], gap: float = COLUMN_GAP) -> DataFrame:
    """Column cuts: middles of vertical white bands at least `gap` wide that no body row crosses.

    With more than two rows the first one is left out. Works on distinct left edges only.
    """
    body = rowed.filter((F.col("n_rows") <= 2) | (F.col("row_no") > 0))
    spans = body.groupBy(*keys, "x0").agg(F.max("x1").alias("x1"))
    ordered = Window.partitionBy(*keys).orderBy("x0")
    reach = F.max("x1").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("x0") - reach >= gap, (F.col("x0") + reach) / 2)
    return spans.select(*keys, cut.alias("cut")).filter(F.col("cut").isNotNull())


def _anchors(words: Column, tolerance: float) -> Column:
    """Baselines of the rows of words sorted by top."""
    start = F.array().cast("array<double>")
    joins = lambda anchors, w: F.coalesce(w["top"] - F.try_element_at(anchors, F.lit(-1)) <= tolerance, F.lit(False))
    return F.aggregate(words, start, lambda anchors, w: F.when(joins(anchors, w), anchors).otherwise(F.concat(anchors, F.array(w["top"]))))


def _cuts(spans: Column, gap: float) -> Column:
    """Middles of the bands at least `gap` wide that no span (x0, x1) of a sorted array crosses."""
    start = F.struct(F.lit(None).cast("double").alias("reach"), F.array().cast("array<double>").alias("cuts"))

    def step(s: Column, span: Column) -> Column:
        wide = F.coalesce(span["x0"] - s["reach"] >= gap, F.lit(False))
        cuts = F.when(wide, F.concat(s["cuts"], F.array((span["x0"] + s["reach"]) / 2))).otherwise(s["cuts"])
        return F.struct(F.greatest(s["reach"], span["x1"]).alias("reach"), cuts.alias("cuts"))

    return F.aggregate(spans, start, step, lambda s: s["cuts"])


def _cells(placed: Column) -> Column:
    """Map of place to text from words(place, x0, top, text) sorted by place and then from left to right."""
    pair = "struct<place:bigint,text:string>"
    start = F.struct(F.lit(None).cast(pair).alias("open"), F.array().cast(f"array<{pair}>").alias("done"))

    def step(s: Column, w: Column) -> Column:
        same = F.coalesce(s["open"]["place"] == w["place"], F.lit(False))
        longer = F.struct(w["place"].alias("place"), F.concat_ws(" ", s["open"]["text"], w["text"]).alias("text"))
        fresh = F.struct(w["place"].alias("place"), w["text"].alias("text"))
        done = F.when(same | s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(F.when(same, longer).otherwise(fresh).cast(pair).alias("open"), done.alias("done"))

    return F.map_from_entries(F.aggregate(placed, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))))


def _grids(words: DataFrame, keys: list[str], tolerance: float, gap: float) -> DataFrame:
    """Grid of each region as `_g`: n_rows, n_cols, and the texts of cells by row * n_cols + column.

    The words of a region fit one array, as a page bounds them; rows, columns and cells are folds over it.
    """
    # Sorted by `sort_array`, which compares structs itself; `array_sort` calls a lambda per comparison.
    sorted_words = F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "text")))
    pages = words.groupBy(*keys).agg(sorted_words.alias("_w"))

    def with_rows(w: Column) -> Column:
        return let(_anchors(w, tolerance), lambda anchors: with_columns(w, anchors))

    def with_columns(w: Column, anchors: Column) -> Column:
        row = lambda x: F.size(F.filter(anchors, lambda a: a <= x["top"])) - 1
        rowed = F.transform(w, lambda x: F.struct(row(x).cast("bigint").alias("row"), x["x0"].alias("x0"), x["x1"].alias("x1"), x["top"].alias("top"), x["text"].alias("text")))
        return let(rowed, lambda r: let(_cuts(body(r, anchors), gap), lambda cuts: grid(r, F.size(anchors).cast("bigint"), cuts)))

    def body(rowed: Column, anchors: Column) -> Column:
        kept = F.filter(rowed, lambda x: (F.size(anchors) <= 2) | (x["row"] > 0))
        return F.sort_array(F.transform(kept, lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"))))

    def grid(rowed: Column, n_rows: Column, cuts: Column) -> Column:
        n_cols = (F.size(cuts) + 1).cast("bigint")
        column = lambda x: F.size(F.filter(cuts, lambda c: c < (x["x0"] + x["x1"]) / 2))
        # Words of a row are met by (top, x0) and then put in x order, so equal x keeps the top order.
        placed = F.transform(rowed, lambda x: F.struct((x["row"] * n_cols + column(x)).cast("bigint").alias("place"), x["x0"].alias("x0"), x["top"].alias("top"), x["text"].alias("text")))
        return F.struct(n_rows.alias("n_rows"), n_cols.alias("n_cols"), _cells(F.sort_array(placed)).alias("cells"))

    return pages.select(*keys, let(F.col("_w"), with_rows).alias("_g"))


def words_to_cells(words: DataFrame, keys: list[str], tolerance: float = ROW_TOLERANCE, gap: float = COLUMN_GAP) -> DataFrame:
    """One row per non-empty cell: row_no, col_no, text, and the grid's n_rows and n_cols."""
    cells = _grids(words, keys, tolerance, gap).select(*keys, "_g.n_rows", "_g.n_cols", F.explode("_g.cells").alias("_at", "text"))
    row = F.floor(F.col("_at") / F.col("n_cols")).cast("bigint")
    return cells.select(*keys, row.alias("row_no"), (F.col("_at") - row * F.col("n_cols")).alias("col_no"), "n_rows", "n_cols", "text")


def words_to_matrix(words: DataFrame, keys: list[str], tolerance: float = ROW_TOLERANCE, gap: float = COLUMN_GAP) -> DataFrame:
    """One grid (array of rows of cells) per region, from one pass over the words."""
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    cell = lambda g, i, j: F.coalesce(F.try_element_at(g["cells"], i * g["n_cols"] + j), F.lit(""))
    matrix = let(F.col("_g"), lambda g: F.transform(upto(g["n_rows"]), lambda i: F.transform(upto(g["n_cols"]), lambda j: cell(g, i, j))))
    return _grids(words, keys, tolerance, gap).select(*keys, matrix.alias("matrix"))


def booktabs_tables(
    captions: DataFrame, edges: DataFrame, words: DataFrame, page_dims: DataFrame, found: DataFrame
) -> DataFrame:
    """Rule-only tables as boxes with caption and raw grid, skipping what `found` already covers."""
    regions = drop_overlaps(booktabs_regions(captions, cluster_rules(edges, page_dims), page_dims), found)
    keys = [*PAGE, "line_no"]
    return words_to_matrix(words_in(words, regions), keys).join(regions, keys)
