"""Pages to overlapping chunks with document-wide numbers and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.bind import let
from quire.operators.scan import BLOCK_COL, carry
from quire.session import settle

# Separators from coarse to fine, and the default sizes in tokens.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE = 400
OVERLAP = 60


_PIECES = "array<struct<text: string, open: boolean>>"
_FOLD = 1024  # pieces of a block
_SPANS = "array<struct<start: int, stop: int, open: boolean>>"


def _pieces(text: Column, separator: Column, size: int) -> Column:
    """Pieces of a text that keep their separator; without one, windows of `size` tokens."""
    cut = F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)
    kept = let(cut, lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.concat(x, separator)).otherwise(x)))
    return F.when(separator == "", T.hard_split(text, size)).otherwise(kept)


def _tail(needs: Column, start: Column, stop: Column, room: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of (kept, need): how many of the last pieces before `stop` hold `room` tokens at most, and how many they hold."""
    # Read by index: a slice would visit the whole array.
    backwards = F.transform(F.sequence(stop - 1, start, F.lit(-1)), lambda i: F.get(needs, i))
    none = F.struct(F.lit(0).alias("kept"), F.lit(0).cast("bigint").alias("need"), F.lit(True).alias("more"))

    def step(t: Column, need: Column) -> Column:
        fits = t["more"] & (t["need"] + need <= room)
        return F.when(fits, F.struct((t["kept"] + 1).alias("kept"), (t["need"] + need).alias("need"), F.lit(True).alias("more"))).otherwise(
            F.struct(t["kept"].alias("kept"), t["need"].alias("need"), F.lit(False).alias("more"))
        )

    return F.aggregate(backwards, none, step, then)


def _spans(needs: Column, size: int, overlap: int) -> Column:
    """Chunks as ranges of pieces: pieces that fit are gathered up to `size` tokens, and of a full chunk the
    longest tail within `overlap` tokens that leaves room begins the next; larger pieces stay open.

    The fold moves numbers only: `at` is the next piece, `start` the first one held and `held` the tokens
    since. A held piece is looked at again only when its chunk is full. Spark copies the state of a fold at
    every step, so pieces are folded in blocks whose state holds the chunks of the block alone.
    """

    def state(at: Column, start: Column, held: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), start.alias("start"), held.alias("held"), out.alias("out"))

    span = lambda start, stop, is_open: F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(is_open).alias("open")))
    flushed = lambda s: F.when(s["start"] < s["at"], F.concat(s["out"], span(s["start"], s["at"], False))).otherwise(s["out"])

    def add(s: Column, need: Column) -> Column:
        after = s["at"] + 1
        room = F.least(F.lit(overlap).cast("bigint"), size - need)
        return (
            F.when(s["held"] + need <= size, state(after, s["start"], s["held"] + need, s["out"]))
            .when(need > size, state(after, after, F.lit(0).cast("bigint"), F.concat(flushed(s), span(s["at"], after, True))))
            .otherwise(_tail(needs, s["start"], s["at"], room, lambda t: state(after, s["at"] - t["kept"], t["need"] + need, flushed(s))))
        )

    none = F.array().cast(_SPANS)

    def add_block(s: Column, first: Column) -> Column:
        own = F.transform(F.sequence(first, F.least(first + _FOLD, F.size(needs)) - 1), lambda i: F.get(needs, i))
        done = lambda b: state(b["at"], b["start"], b["held"], F.concat(s["out"], b["out"]))
        return F.aggregate(own, state(s["at"], s["start"], s["held"], none), add, done)

    blocks = F.sequence(F.lit(0), F.size(needs) - 1, F.lit(_FOLD))
    ranges = F.aggregate(blocks, state(F.lit(0), F.lit(0), F.lit(0).cast("bigint"), none), add_block, flushed)
    return F.when(F.size(needs) > 0, ranges).otherwise(none)


def _merged(pieces: Column, size: int, overlap: int) -> Column:
    """Chunks of an array of pieces, in order."""

    def text(p: Column, s: Column) -> Column:
        run = F.array_join(F.transform(F.sequence(s["start"], s["stop"] - 1), lambda i: F.get(p, i)), "")
        return F.struct(F.when(s["open"], run).otherwise(T.strip(run)).alias("text"), s["open"].alias("open"))

    ranges = lambda p: let(F.transform(p, T.count_tokens), lambda needs: _spans(needs, size, overlap))
    return let(pieces, lambda p: F.transform(ranges(p), lambda s: text(p, s)))


def _opened(whole: Column, separator: Column, size: int, overlap: int) -> Column:
    """Cuts the open pieces of an array that hold the separator, and leaves the others as they are."""

    def opened(p: Column) -> Column:
        cut = p["open"] & F.contains(p["text"], separator)
        return F.when(cut, _merged(_pieces(p["text"], separator, size), size, overlap)).otherwise(F.array(p))

    return F.when(F.exists(whole, lambda p: p["open"]), F.flatten(F.transform(whole, opened))).otherwise(whole)


def chunk_text(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks, in Spark expressions. Separators are tried from coarse to fine; at each, only the
    pieces that are still too large are cut. Short text passes as it is.

    The separators are folded over, so the expression holds the chunking of one level only once.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    whole = F.array(F.struct(T.strip(c).alias("text"), (T.count_tokens(T.strip(c)) > size).alias("open"))).cast(_PIECES)
    levels = F.array(*map(F.lit, SEPARATORS))
    texts = F.aggregate(
        levels, whole, lambda w, separator: _opened(w, separator, size, overlap),
        lambda w: F.filter(F.transform(w, lambda p: p["text"]), lambda t: T.strip(t) != ""),
    )
    return F.when(c.isNotNull(), texts)


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Add `chunks` to every page. Pages are independent, so this needs no shuffle."""
    return pages.withColumn("chunks", chunk_text(F.col("text"), size, overlap))


def label_chunks(chunked: DataFrame, default: str = T.FRONT_MATTER, **rules) -> DataFrame:
    """One row per chunk: number within the paper, and section.

    A chunk takes the first heading inside it, else the last heading of an earlier chunk of its
    page, else the section at the start of its page. Page text itself is not moved: one exchange by
    (paper, block of pages) carries the chunks, and everything after works on that partitioning.
    """
    page_heading = F.try_element_at(T.headings_of(F.col("text"), **rules), F.lit(-1))
    has_section = "section" in chunked.columns
    slim = chunked.withColumn("_page_last", F.lit(None).cast("string") if has_section else page_heading).withColumn(
        "_n", F.size("chunks").cast("bigint")
    ).drop("text")
    placed = carry(slim, ["paper_id"], "page", sums={"_base": "_n"}, lasts={"_before": "_page_last"})
    start = F.col("section") if has_section else F.coalesce("_before", F.lit(default))
    extra = [c for c in chunked.columns if c not in ("paper_id", "page", "text", "chunks", "section")]
    rows = placed.select(
        "paper_id", "page", BLOCK_COL, *extra, "_base", start.alias("_start"), F.posexplode("chunks").alias("_pos", "_chunk")
    )
    heads = T.headings_of(F.col("_chunk"), **rules)
    rows = rows.withColumn("_heads", heads)
    earlier = Window.partitionBy("paper_id", BLOCK_COL, "page").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    running = F.last(F.try_element_at("_heads", F.lit(-1)), ignorenulls=True).over(earlier)
    return rows.select(
        "paper_id",
        *extra,
        (F.col("_base") + F.col("_pos")).cast("bigint").alias("chunk_index"),
        "page",
        F.coalesce(F.try_element_at("_heads", F.lit(1)), running, "_start").alias("section"),
        F.regexp_replace("_chunk", r"\n{2,}", "\n\n").alias("text"),
    )


def chunk_papers(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, **rules) -> DataFrame:
    """Cleaned pages straight to labelled chunks. Blank pages have no chunks.

    Numbering reads the chunked pages twice (rows and block totals), so they are settled in between.
    """
    return label_chunks(settle(chunk_pages(pages, size, overlap)), **rules)
