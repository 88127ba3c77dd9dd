import html
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from quire.llm import cover_search, html_density
from tests.llm.conftest import SF, VECTORS, odd_rows
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_ngram_join import near_copy
from tests.llm.test_packing import check
from tests.llm.test_text_operators import poisson
from tools.compare import compare, oracle_connection

# Pages


def test_articles_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_density.op10_html_density(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one<p>two <b>bold\n  text<br>three</p>", "one\ntwo bold text three"),
        ("<body><nav><a href=/>Home</a></nav><div id=main><h2>Title</h2><p>Long enough text here.</p><p>And more of it.</p></div><footer>foot</footer>", "Title\nLong enough text here.\nAnd more of it."),
        ("<div class='has-sidebar'><div class=sidebar><p>aside</p></div><article><h1>T</h1><p>Body text.</p><section id='comments'><p>Reader says</p></section></article></div>", "T\nBody text."),
        ("<main><p>A &lt;tag&gt; &#233; &eacute;</p><script>if (a<b) { '</p>' }</script><form><p>Name</p></form><ul><li>x<li>y</ul></main>", "A <tag> é é\nx\ny"),
        ("<article><p>before <!-- <p>hidden</p> --> after</p><p hidden>not shown</p></article>", "before after"),
        ("<body><p>open <a href='x>y'>link</a> end</p><p>5 < 6 and <3", "open link end\n5 < 6 and <3"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ],
)
def test_small_pages(page, text):
    assert html_density.main_text(page) == text


def test_short_blocks_beside_the_densest_part_are_kept():
    paragraphs = "".join(f"<p>{'long words ' * 45}{i}</p>" for i in range(10))
    body = "\n".join(f"{'long words ' * 45}{i}" for i in range(10))
    head = "<h1>A headline of about forty characters</h1><p>By someone</p>"
    kept = f"A headline of about forty characters\nBy someone\n{body}"
    for top in ("article", "main", "body"):
        assert html_density.main_text(f"<{top}>{head}<div>{paragraphs}</div></{top}>") == kept
    last = f"<article><section>{paragraphs}</section><section><h2>End</h2><p>{'short ' * 20}</p></section></article>"
    assert html_density.main_text(last) == f"{body}\nEnd\n{('short ' * 20).strip()}"
    assert html_density.main_text(f"<article>Directly here<div>{paragraphs}</div>and here</article>") == f"Directly here\n{body}\nand here"
    links = "".join(f"<li><a href=/{i}>story {i}</a></li>" for i in range(9))
    mixed = f"<div><ul>{links}</ul><p>A plain line.</p></div>"
    assert html_density.main_text(f"<body><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a>{mixed}<div>{paragraphs}</div><h1><a href=/t>Title</a></h1>") == f"A plain line.\n{body}\nTitle"


def test_words_of_class_and_id_alone_do_not_drop_content():
    paragraphs = "".join(f"<p>Main text in line {i} of the page.</p>" for i in range(6))
    body = "\n".join(f"Main text in line {i} of the page." for i in range(6))
    for page in (
        "<body><article class='post comments-open'>{}</article>",
        "<body><div id=content class='has-sidebar'>{}</div>",
        "<body><div class='layout sidebar-right'>{}</div><div class=sidebar><p>aside</p></div>",
        "<body><article class=promo id=related>{}</article>",
    ):
        assert html_density.main_text(page.format(paragraphs)) == body, page
    for word in ("share", "notice", "promo", "header", "widget"):
        assert html_density.main_text(f"<article><h1>T</h1><div class=post-{word}><p>Own words.</p></div>{paragraphs}</article>") == f"T\nOwn words.\n{body}"
        blocks = "".join(f"<div class='{word}'><p>Main text in line {i} of the page.</p></div>" for i in range(6))
        assert html_density.main_text(f"<body>{blocks}</body>") == body
        assert html_density.main_text(f"<article>{paragraphs}<div class={word}><a href=/a>One</a> <a href=/b>Two</a></div></article>") == body
    assert html_density.main_text(f"<body><div class='cookie-banner'>Yes?</div><div class=post-header><h1>T</h1></div><div>{paragraphs}</div>") == f"T\n{body}"
    comments = "<div id=comments><ol><li class=comment><article class=comment-body><p>Reader says</p></article></ol></div>"
    assert html_density.main_text(f"<main><article class=post>{paragraphs}</article>{comments}</main>") == body


@pytest.mark.parametrize("n", [1, 48, 49, 50, 200])
def test_nested_articles_at_any_number(n):
    nested = "".join(f"<div><article><p>Part {i} of the whole text.</p></article></div>" for i in range(n))
    page = f"<body><div><p>Outside of the article lies this line of some length.</p></div><article>{nested}</article>"
    assert html_density.main_text(page) == "\n".join(f"Part {i} of the whole text." for i in range(n))


def test_forms_are_judged_by_their_text():
    says = "Paragraph {} of the article with many words that say something new about the sea, and the ships on it."
    article = "<h1>Title of it</h1>" + "".join(f"<p>{says.format(i)}</p>" for i in range(6))
    text = "\n".join(["Title of it", *[says.format(i) for i in range(6)]])
    field = "<fieldset><p>A boxed remark, which is a part of the article.</p></fieldset>"
    assert html_density.main_text(f"<body><form id=frame><input type=hidden name=state><div>{article}</div></form></body>") == text
    assert html_density.main_text(f"<body><form><nav><a href=1>Home</a></nav><input name=q><div>{article}{field}</div></form></body>") == text + "\nA boxed remark, which is a part of the article."
    assert html_density.main_text(f"<body><div>{article}</div><form><label>Name</label><p>Send us a message</p><input><button>Send</button></form></body>") == text


def test_pages_nested_deeply_and_long():
    deep = "<div>" * 20_000 + "core text" + "</div>" * 20_000
    assert html_density.main_text(deep) == "core text"
    assert len(html_density.main_text("<article>" + "<p>some words</p>" * 30_000)) == 30_000 * 11 - 1
    assert html_density.main_text("<li>" * 5000 + "x") == "x"


def test_pages_frame(spark):
    rows = [(1, "u", "<p>x</p>", "!"), (None, None, None, "!"), (1, "u", "<p>x</p>", "!")]
    got = html_density.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == {(1, "u", "x", 1): 2, (None, None, "", 0): 1}
    assert html_density.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# Vectors


def brute_search(rows, wanted, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in ok if wanted(i)}
    out = Counter()
    for q in {i for i, _ in asked}:
        scores = sorted((-min(max(sum(a * b for a, b in zip(w, v, strict=True)), -(2**63)), 2**63 - 1), i) for j, w in asked if j == q for i, v in ok if i != q and len(v) == len(w))
        for rank, (s, i) in enumerate(scores[:k], 1):
            out[q, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("block,leaf", [(8192, 64), (20, 4)])
def test_search_equals_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(cover_search, "BLOCK", block)
    monkeypatch.setattr(cover_search, "GROUP", 3)
    monkeypatch.setattr(cover_search, "LEAF", leaf)
    monkeypatch.setattr(cover_search, "CENTRES", 5)
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # one common vector
    rows += [(600, None), (605, [1.0, None]), (610, [float("nan")] * 8), (615, [float("inf")] * 8), (None, rows[0][1]), (620, [1.0, 2.0]), (625, [2.0, -3.0]), (630, []), (10, rows[10][1]), (15, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "!") for i, v in rows], VECTORS).repartition(3)
    got = cover_search.top_k(df.where("vec_id % 5 = 0"), df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("size", [1e6, 1e7, 1e14])
def test_search_is_exact_for_large_components(spark, size):
    rng = np.random.default_rng(11)
    rows = [(i, (size * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, "!") for i, v in rows], VECTORS).repartition(3)
    got = cover_search.top_k(df.where("vec_id % 5 = 0"), df)
    assert Counter(map(tuple, got.collect())) == brute_search(rows, lambda i: i % 5 == 0)


def test_search_query_equals_sql(spark):
    assert compare(cover_search.op2_cover_search(spark, SF), oracle_connection(SF), cover_search._SQL) == ""


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(0, [1.0], "!")], VECTORS)
    assert cover_search.top_k(none, none).count() == 0
    assert cover_search.top_k(one, one).count() == 0
    assert cover_search.top_k(none, one).count() == 0


def test_products_beyond_double_precision():
    a, b = np.array([[2**40 + 1, 1]]), np.array([[2**20 + 1, 3]])
    assert int(cover_search.products(a, b)[0, 0]) == (2**40 + 1) * (2**20 + 1) + 3


# Pipeline


def strings_removed(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone, new = bytearray(len(data)), []
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            if key in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(key)
        out.append((doc, bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else text, new))
    return {d: t for d, t, _ in out}


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF)
    kept = {r.doc_id for r in first.collect()}
    assert kept == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    second = stages["ngram_join"](spark, first, SF)
    classes = {d: c for d, c, _ in near([(i, rows[i].text) for i in sorted(kept)])}
    assert Counter(r.doc_id for r in second.collect()) == Counter(i for i in kept if classes[i] == i)
    third = stages["suffix_dedup"](spark, second, SF)
    texts = strings_removed([(i, rows[i].text) for i in kept if classes[i] == i])
    assert {r.doc_id: (r.text, r.n_chars) for r in third.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    for stage in (first, second, third):
        assert stage.columns == docs.columns
    fourth = stages["mixing"](spark, third, SF)
    n = Counter(rows[i].source for i in texts)
    total = sum(m**0.7 for m in n.values())
    want = Counter({i: poisson(n[rows[i].source] ** 0.7 / total * len(texts) / n[rows[i].source], "mix-1", i) for i in texts})
    assert Counter(r.doc_id for r in fourth.collect()) == +want
    check(stages["packing"](spark, fourth, SF), [(r.doc_id, r.text) for r in fourth.collect()])


def test_one_row_of_each_group_without_ids_and_with_repeated_ids(spark):
    first, second, third, other = near_copy(), near_copy().upper(), near_copy().replace("w", "v"), "of its own and with no copy"
    near_first, near_second, near_third = near_copy(0), near_copy(0).upper(), near_copy(0).replace("w", "v")
    rows = [
        (5, first), (None, near_first), (5, near_second), (3, second), (3, second),  # 5 stands for one group, 3 for the other
        (None, third), (None, near_third), (None, third), (7, other), (7, near_copy().replace("w", "u")), (8, None), (None, " "), (None, " "),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "!") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string")
    got = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, SF)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept[None, third] + kept[None, near_third] == 1
    assert Counter({k: n for k, n in kept.items() if k[0] is not None or k[1] == " "}) == {(5, first): 1, (3, second): 1, (7, other): 1, (7, near_copy().replace("w", "u")): 1, (8, None): 1, (None, " "): 2}
    assert sum(kept.values()) == 8


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_without_labels_keeps_texts_with_letters(spark, lang):
    rows = [(1, "some words", lang), (2, "日本", lang), (3, "12 !", lang), (4, None, lang), (None, "é", lang), (6, "", lang)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == {(1, "some words"): 1, (2, "日本"): 1, (None, "é"): 1}


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns, name
        n = corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
        assert (n > 0) == (frame is odd_docs)
    assert len(odd_rows()) == odd_docs.count()


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {m[1] for n in names if (m := re.match(r"op(\d+)_", n))} == {str(n) for n in range(1, 14)}
    assert "pipeline" in names
    random.seed(0)
