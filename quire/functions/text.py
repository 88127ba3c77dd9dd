"""Text expressions: splitting, trimming, headings, page numbers, token estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.bind import let

# Section names recognised as headings without a number.
KNOWN_SECTIONS = (
    "abstract", "introduction", "background", "related work", "literature review", "method", "methods",
    "methodology", "approach", "model", "experiments", "experimental setup", "evaluation", "results",
    "discussion", "analysis", "limitations", "future work", "conclusion", "conclusions", "references",
    "acknowledgements", "acknowledgments", "appendix",
)
# Patterns for numbered headings, bare page numbers and the abstract.
NUMBERED_HEADING = r"^(\d{1,2}(\.\d{1,2})*\.?|[IVX]{1,4}\.)\s+([A-Z][A-Za-z\-,:& ]{2,60})\z"
PAGE_NUMBER = r"(?iuU)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?\z"
ABSTRACT = (
    r"(?isuU)\babstract\b[\s.:\-—]*(.+?)(?=\n\s*(?:\d{1,2}\.?\s*|I\.\s*)?(?:introduction|keywords|index terms)\b)"
)
MAX_HEADING = 70
MAX_ABSTRACT = 3000
FRONT_MATTER = "Front Matter"

# Every character that counts as white space at the ends of a text.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\s\x1c-\x1f]"
_RARE_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Trim every Unicode space at both ends."""
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


def lines_of(c: Column) -> Column:
    """Array of lines, without the empty piece after a final line break."""
    parts = F.when(c.rlike(_RARE_BREAK), F.split(c, _LINE_BREAK)).otherwise(F.split(c, "\n"))
    return let(
        parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    )


def count_tokens(c: Column) -> Column:
    """Token estimate: four characters per token, rounded up."""
    return F.ceil(F.length(c) / 4).cast("bigint")


def title_case(c: Column) -> Column:
    """Capitalise after every non-letter, not only after spaces."""
    words = F.split(c, r"(?<=[^\p{L}])|(?=[^\p{L}])")
    return F.array_join(F.transform(words, F.initcap), "")


def detect_heading(
    line: Column,
    known: Sequence[str] = KNOWN_SECTIONS,
    numbered: str = NUMBERED_HEADING,
    max_length: int = MAX_HEADING,
) -> Column:
    """Title-cased heading, or null when the line is not one."""
    return let(strip(line), lambda x: _heading(x, known, numbered, max_length))


def _heading(text: Column, known: Sequence[str], numbered: str, max_length: int) -> Column:
    numbered_title = F.regexp_extract(text, numbered, 3)
    plain = F.rtrim(F.lower(text), F.lit(":."))
    return (
        F.when((F.length(text) == 0) | (F.length(text) > max_length), None)
        .when(numbered_title != "", title_case(strip(numbered_title)))
        .when(plain.isin(*known), title_case(plain))
    )


def headings_of(
    text: Column, known: Sequence[str] = KNOWN_SECTIONS, numbered: str = NUMBERED_HEADING, max_length: int = MAX_HEADING
) -> Column:
    """All headings of a text in order. Lines too long to be headings are passed over first."""
    short = F.filter(F.transform(lines_of(text), strip), lambda x: F.length(x).between(1, max_length))
    return F.filter(F.transform(short, lambda x: _heading(x, known, numbered, max_length)), lambda x: x.isNotNull())


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(PAGE_NUMBER)


def hard_split(c: Column, size: int) -> Column:
    """Fixed windows of four characters per token, cut in one pass."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{4 * size}}}"), F.lit(0))


def slug(c: Column, fallback: str = "paper", limit: int = 60) -> Column:
    """File-name form of a title. Only the start that gives `limit` characters is rewritten, however long the text."""
    start = F.regexp_extract(c, rf"^(?:[A-Za-z0-9]|[^A-Za-z0-9]++){{0,{limit}}}", 0)
    name = F.trim(F.left(F.regexp_replace(start, "[^A-Za-z0-9]+", "_"), F.lit(limit)), F.lit("_"))
    return let(name, lambda n: F.when(n == "", F.lit(fallback)).otherwise(n))


def present(c: Column) -> Column:
    """Null for the spellings of "no value" that model replies use."""
    return F.when(c.isNull() | c.isin("", "null", "None"), None).otherwise(c)
