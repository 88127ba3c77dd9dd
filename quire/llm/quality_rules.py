"""Quality rules: a table of thresholds compiled into one projection, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words of a repeated window
MIN_WORDS = 20
MAX_REPEATED = 30  # percent
# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    *("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "it", "as", "by", "this", "at", "from", "are"),
    *("der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "nicht", "ein", "eine", "als", "auch"),
    *("le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "est", "pour", "sur", "pas", "du", "en", "avec"),
    *("el", "los", "las", "y", "del", "se", "con", "por", "una", "su", "para", "no", "al", "lo"),
)


@dataclass(frozen=True)
class Rule:
    """A ratio or count and the range in which a text is kept; None leaves that side open."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_word_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.02, None),
    Rule("letter_word_ratio", 0.6, None),
    Rule("echo_word_ratio", None, 0.50),
    Rule("dup_line_ratio", None, 0.40),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.30),
)


def _bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once; a lambda keeps the optimizer from repeating it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words of a text, split at the six ASCII white-space characters."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _windows(w: Column) -> Column:
    """Hash of each window of eight words by its start; two different windows of a text share the
    64-bit value with a probability below 1e-10 even in a text of 20,000 words."""
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    return F.when(F.size(w) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words lying in a window that occurs twice or more, from the hashes by start."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        at = F.sequence(F.lit(0), n - 1)
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = F.filter(at, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda i: F.get(s, i)["i"]))

    def total(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bound(paired, lambda s: total(of_sorted(s))))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, ratios) of whole texts; null is an empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            _bound(_windows(w), _covered).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]\s"))).alias("n_bullets"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipses"),
        )

    chars = F.length(text)
    row = docs.select(
        F.col("doc_id"),
        _bound(words(text), of_words).alias("w"),
        _bound(F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word)), of_lines).alias("l"),
        (chars - F.length(F.regexp_replace(text, SPACE + "+", ""))).alias("spaces"),
        (chars - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols"),
        chars.alias("chars"),
        F.regexp_count(F.lower(text), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(sorted(set(STOP_WORDS))) + r")(?=[\x20\x09-\x0D.,;:!?]|$)")).alias("stops"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?\p{L}")).alias("lettered"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))")).alias("echoes"),
    )
    n, per_word, per_line = F.col("w.n_words"), F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest(F.col("l.n_lines"), F.lit(1))
    return row.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        (F.col("chars") - F.col("spaces")).cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"),
        F.col("l.n_dup_lines").cast("bigint").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("bigint").alias("n_repeat_words"),
        ((F.col("chars") - F.col("spaces")) / per_word).alias("mean_word_chars"),
        (F.col("symbols") / per_word).alias("symbol_word_ratio"),
        (F.col("stops") / per_word).alias("stop_word_ratio"),
        (F.col("lettered") / per_word).alias("letter_word_ratio"),
        (F.col("echoes") / per_word).alias("echo_word_ratio"),
        (F.col("l.n_dup_lines") / per_line).alias("dup_line_ratio"),
        (F.col("l.n_bullets") / per_line).alias("bullet_line_ratio"),
        (F.col("l.n_ellipses") / per_line).alias("ellipsis_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one condition over the measured columns."""
    held = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            held = held & (F.col(rule.metric) >= rule.low)
        if rule.high is not None:
            held = held & (F.col(rule.metric) <= rule.high)
    return held


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, base counts, base_failed, kept, ratios), one row per input row.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each by itself;
    columns of the input other than doc_id and text are ignored.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def _sql() -> str:
    has = r"[^\x20\x09-\x0D]"
    stops = "|".join(sorted(set(STOP_WORDS)))
    checks = " AND ".join(
        f"{r.metric} {op} {v!r}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_no, regexp_extract_all(text, '{has}+') AS w FROM t),
grams AS (SELECT row_no, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT row_no, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row_no, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS c
  FROM (SELECT row_no, i, lag(i) OVER (PARTITION BY row_no ORDER BY i) AS p FROM twice) GROUP BY row_no),
l AS (SELECT row_no, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{has}')) AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c, 0)::BIGINT AS n_repeat_words, greatest(len(l), 1) AS n_lines, greatest(len(w), 1) AS per_word,
    len(list_filter(w, lambda x: regexp_full_match(lower(x), '({stops})([.,;:!?](.|\\n)*)?'))) AS stops,
    len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS lettered,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echoes,
    len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]\\s'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS ellipses
  FROM t JOIN w USING (row_no) JOIN l USING (row_no) LEFT JOIN covered USING (row_no)),
r AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_chars / per_word AS mean_word_chars, n_symbols / per_word AS symbol_word_ratio,
    stops / per_word AS stop_word_ratio, lettered / per_word AS letter_word_ratio, echoes / per_word AS echo_word_ratio, n_dup_lines / n_lines AS dup_line_ratio,
    bullets / n_lines AS bullet_line_ratio, ellipses / n_lines AS ellipsis_line_ratio,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {checks} AS kept FROM r
"""


@query("op5_quality_rules", _sql())
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(table(spark, folder, "documents"))
