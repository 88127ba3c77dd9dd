import re
import uuid

from pyspark.sql import functions as F

from quire.functions import ids, mathtext, text as T
from quire.sources.admission import url_filename, url_list


def test_clean_page_joins_words_and_drops_page_numbers(spark):
    from quire.operators.cleaning import clean_pages

    pages = spark.createDataFrame([("p", 1, "A light-\nhouse    keeper.\n\n\n\n47\nLast row")], "paper_id string, page int, text string")
    assert clean_pages(pages).first()["text"] == "A lighthouse keeper.\n\nLast row"


def test_headings(one):
    got = one(T.detect_heading, "7.4 Boat Sheds", "REFERENCES", "The keeper lit the lamp at dusk every day.", "VI. Rope-Making Notes", "  Future Work:. ")
    assert got == ["Boat Sheds", "References", None, "Rope-Making Notes", "Future Work"]


def test_strip_and_lines_know_unicode(one):
    assert one(T.strip, "  a b \u0085") == "a b"
    assert one(T.lines_of, "a\r\nb\x0cc d\n") == ["a", "b", "c", "d"]
    assert one(T.lines_of, "") == []


def test_math_display_inline_and_currency(one):
    assert one(mathtext.is_display_equation, "Q(φ) = ∫ ρ dz (12b)", "The tide height over the whole harbour is φ = 2") == [True, False]
    assert one(mathtext.normalize_math, "Q(φ) = ∫ ρ dz (12b)") == r"$$ Q(\phi ) = \int \rho dz \tag{12b} $$"
    texts = ["whenever λ ∈ ℕ and γ2 stays small", "the fee of $3 for ψ", "only words here", "over ℚ alone", "ﬁve ½ cups", "no-\nte  one \n\n\n\n two"]
    inline, money, plain, rational, folded, mended = one(mathtext.normalize_text, *texts)
    assert inline == r"whenever $\lambda \in \mathbb{N} and \gamma_{2}$ stays small"
    assert money == texts[1] and plain == texts[2] and rational == r"over $\mathbb{Q}$ alone"
    assert folded == "five 1⁄2 cups" and mended == "note one\n\ntwo"


def test_every_symbol_has_its_spelling(one):
    spellings = {**mathtext.GREEK, **mathtext.OPERATORS, **{k: rf"\mathbb{{{v}}}" for k, v in mathtext.DOUBLE_STRUCK.items()}}
    got = one(mathtext.normalize_math, *[f"so {symbol} here" for symbol in spellings])
    assert got == [f"so ${latex}$ here" for latex in spellings.values()]
    # Between two runs, several on a line, and next to characters that a formula may hold.
    assert one(mathtext.normalize_math, "α and then β1/γ, or Δ") == r"$\alpha$ and then $\beta_{1}/\gamma$, or $\Delta$"


def test_only_nfkc_runs_in_python(spark):
    plan = spark.range(1).select(mathtext.normalize_text(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_uuid5_matches_the_standard(spark):
    rows = spark.createDataFrame([("paper-a", i) for i in range(50)] + [("Ünï", 7)], "p string, i int")
    for r in rows.withColumns({"c": ids.chunk_id(F.col("p"), F.col("i")), "t": ids.table_id(F.col("p"), F.col("i"))}).collect():
        assert r["c"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['p']}:{r['i']}"))
        assert r["t"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['p']}:table:{r['i']}"))


def test_urls(one):
    assert one(url_list, "a, b\n\n c ,,") == ["a", "b", "c"]
    assert one(url_filename, "https://x.org/abs/12.PDF?dl=1", "https://x.org/paper") == ["12.PDF", "paper.pdf"]


def test_slug(one):
    assert one(T.slug, "A: b/c!", "***") == ["A_b_c", "paper"]


def test_slug_rewrites_only_the_start(spark):
    texts = ["", None, "--- a", "é" * 300 + "b" * 100, "a-" * 100, "ab" * 100, " \n" * 5000 + "x" * 59 + "!y", "!!!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select("t", T.slug(F.col("t")).alias("s"))
    plain = lambda t: t if t is None else re.sub("[^A-Za-z0-9]+", "_", t)[:60].strip("_") or "paper"
    assert {r["t"]: r["s"] for r in df.collect()} == {t: plain(t) for t in texts}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == plan.count("regexp_replace(regexp_extract(") == 1
