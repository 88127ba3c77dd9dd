import random

from pyspark.sql import functions as F

from quire.operators import chunking, cleaning, scan

SCHEMA = "paper_id string, page int, text string"
PAGES = [
    "Abstract\nTide tables of eleven harbours were digitised.\n1 Introduction\nHarbour masters kept ledgers by hand.",
    "2 Ledgers\nEach row names a quay, an hour and a depth.\n" + "A clerk copied the row twice. " * 70,
    "3 Findings\nDepths agree within two inches.\n4 Outlook\nOlder ledgers await copying.",
]


def paper(spark):
    raw = [("p", i + 1, f"Annals of Harbour Ledgers\n{body}\n{i + 1}") for i, body in enumerate(PAGES)]
    return cleaning.clean_pages(spark.createDataFrame(raw, SCHEMA))


def test_header_sections_abstract_and_full_text(spark):
    pages = paper(spark)
    assert not pages.filter(F.contains("text", F.lit("Annals of"))).count()
    sections = {r["page"]: r["section"] for r in cleaning.assign_sections(pages).collect()}
    assert sections == {1: "Front Matter", 2: "Introduction", 3: "Ledgers"}
    assert cleaning.extract_abstract(pages).first()["abstract"] == "Tide tables of eleven harbours were digitised."
    whole = cleaning.full_text(pages).collect()
    assert len(whole) == 1 and whole[0]["text"] == "\n\n".join(r["text"] for r in pages.orderBy("page").collect())
    parts = cleaning.full_text_parts(pages, pages_per_part=2).orderBy("part").collect()
    assert [p["part"] for p in parts] == [0, 1] and "\n\n".join(p["text"] for p in parts) == whole[0]["text"]


def test_full_text_of_many_pages_is_one_row(spark):
    pages = spark.range(1, 3001).select(F.lit("p").alias("paper_id"), F.col("id").cast("int").alias("page"), F.concat(F.lit("t"), "id").alias("text"))
    assert [r["text"] for r in cleaning.full_text(pages).collect()] == ["\n\n".join(f"t{i}" for i in range(1, 3001))]


def test_chunks_keep_page_and_section(spark):
    chunks = chunking.chunk_papers(paper(spark), 120, 20).orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert [c["page"] for c in chunks] == sorted(c["page"] for c in chunks) and {c["page"] for c in chunks} == {1, 2, 3}
    assert [c["section"] for c in chunks if c["page"] == 3] == ["Findings"]
    assert {c["section"] for c in chunks if c["page"] == 2} == {"Ledgers"}


def chunks_of(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["c"] for r in df.orderBy("i").select(chunking.chunk_text(F.col("t"), size, overlap).alias("c")).collect()]


def test_chunks_hold_their_size_and_lose_nothing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", ". ", "\n", "\n\n", "x" * 90]) for _ in range(200)) for _ in range(50)]
    for text, got in zip(texts, chunks_of(spark, texts, 20, 5)):
        assert all(0 < -(-len(c) // 4) <= 20 for c in got)
        assert "".join("".join(got).split()).count("x") >= text.count("x")
        at = 0
        for c in chunks_of(spark, [text], 20, 0)[0]:  # without overlap, the chunks in order are the text
            at = text.index(c, at) + len(c)


def brute_chunks(text, size, overlap, separators=chunking.SEPARATORS):
    need = lambda t: -(-len(t) // 4)
    if need(text) <= size:
        return [text]
    first, finer = separators[0], separators[1:]
    if first and first not in text:
        return brute_chunks(text, size, overlap, finer)
    if first:
        cut = text.split(first)
        pieces = [x + first for x in cut[:-1]] + cut[-1:]
    else:
        pieces = [text[i : i + 4 * size] for i in range(0, len(text), 4 * size)]
    out, held = [], []
    for piece in pieces:
        if need(piece) > size:
            if held:
                out.append("".join(held).strip())
            out += brute_chunks(piece, size, overlap, finer)
            held = []
            continue
        if held and sum(map(need, held)) + need(piece) > size:
            out.append("".join(held).strip())
            while held and sum(map(need, held)) > min(overlap, size - need(piece)):
                held.pop(0)
        held.append(piece)
    return out + (["".join(held).strip()] if held else [])


def test_chunks_of_long_pages_equal_brute_force(spark):
    # More pieces than a block of the fold holds, at every level; characters beyond 16 bits count once.
    rng = random.Random(3)
    words = ["ab", "c", "𝔼é", "transformation", "z𝔼" * 60]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(n)).strip() for n, seps in (
        (3000, [" "]), (2500, ["\n", " ", " ", "\n\n", ". "]), (40, ["\n\n"]), (1024, [" "]), (2048, ["\n\n"]))] + ["q𝔼" * 9000]
    for size, overlap in ((20, 5), (7, 6), (400, 60)):
        for text, got in zip(texts, chunks_of(spark, texts, size, overlap)):
            assert got == [c for c in brute_chunks(text, size, overlap) if c.strip()]


def test_chunks_worked_by_hand(spark):
    # Sizes in tokens: "red " 1, "blue " 2, "violet " 2, "tan" 1.
    assert chunks_of(spark, ["red blue violet tan"], 3, 1) == [["red blue", "violet tan"]]
    assert chunks_of(spark, ["red blue violet tan"], 2, 1) == [["red", "blue", "violet", "tan"]]
    assert chunks_of(spark, ["red red blue tan"], 3, 1) == [["red red", "red blue", "tan"]]
    # A paragraph that fits stays whole and gives nothing to the oversized one after it.
    assert chunks_of(spark, ["note\n\n" + "z" * 20, " \n\t", None], 2, 1) == [["note", "z" * 8, "z" * 8, "z" * 4], [], None]


def brute_carry(rows):
    out, total, last = [], {}, {}
    for k, p, n, v in sorted(rows):
        out.append((k, p, total.get(k, 0), last.get(k)))
        total[k] = total.get(k, 0) + n
        last[k] = v if v is not None else last.get(k)
    return out


def test_carry_equals_a_plain_running_window_over_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 5), rng.choice([None, None, f"h{i}"])) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, p int, n int, v string")
    for block in (1, 8, 5000):
        got = scan.carry(df, ["k"], "p", {"total": "n"}, {"last": "v"}, block=block).select("k", "p", "total", "last")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == brute_carry(rows)


def test_carry_cuts_by_rows_not_by_numbers(spark, monkeypatch):
    # Sparse numbers, all in few large gaps: summaries of the hot group stay bounded by the cuts.
    monkeypatch.setattr(scan, "CUTS", 20)
    rng = random.Random(5)
    places = sorted({rng.choice([0, 10**6, 10**9]) + rng.randint(-20000, 20000) * 7 for _ in range(3000)})
    rows = [("hot", p, rng.randint(0, 3), rng.choice([None, None, f"h{p}"])) for p in places] + [("cold", 5, 1, "x"), ("cold", 9, 1, None)]
    got = scan.carry(spark.createDataFrame(rows, "k string, p bigint, n int, v string"), ["k"], "p", {"total": "n"}, {"last": "v"}, block=8).collect()
    assert sorted((r["k"], r["p"], r["total"], r["last"]) for r in got) == brute_carry(rows)
    sizes = [sum(r["k"] == "hot" and r[scan.BLOCK_COL] == b for r in got) for b in {r[scan.BLOCK_COL] for r in got if r["k"] == "hot"}]
    assert 5 <= len(sizes) <= 41 and max(sizes) < len(rows) / 3


def test_carry_of_nothing_and_of_several_keys(spark):
    shape = "k string, j int, p int, n int, v string"
    assert scan.carry(spark.createDataFrame([], shape), ["k", "j"], "p", {"total": "n"}, {"last": "v"}).count() == 0
    rows = [("a", i % 2, i, 1, f"v{i}" if i % 5 == 0 else None) for i in range(60)]
    got = scan.carry(spark.createDataFrame(rows, shape), ["k", "j"], "p", {"total": "n"}, {"last": "v"}, block=4).collect()
    want = brute_carry([(f"{k}{j}", p, n, v) for k, j, p, n, v in rows])
    assert sorted((f"{r['k']}{r['j']}", r["p"], r["total"], r["last"]) for r in got) == want


def test_first_rows_with_and_without_slices(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    for limit in (3, 1500):
        got = scan.first_rows(df, ["g"], [F.desc("v")], limit)
        assert got.count() == 2 * limit and got.agg(F.min("v")).first()[0] == 6000 - 2 * limit


def test_elect_title(spark):
    papers = spark.createDataFrame([("a", "Untitled doc", "a.pdf"), ("b", "A real title", "b.pdf"), ("c", None, "c.x.pdf"), ("d", "", "d.pdf")], "paper_id string, meta_title string, file_name string")
    spans = spark.createDataFrame([("a", 1, 1, 18.0, "Big"), ("a", 1, 2, 17.6, " Title "), ("a", 1, 3, 10.0, "small"), ("d", 1, 1, 9.0, "x")], "paper_id string, page int, seq int, size double, text string")
    lines = spark.createDataFrame([("c", "no"), ("d", "abc\nFirst long line")], "paper_id string, text string")
    got = {r["paper_id"]: r["title"] for r in cleaning.elect_title(papers, spans, lines).collect()}
    assert got == {"a": "Big Title", "b": "A real title", "c": "c.x", "d": "First long line"}


def test_pages_of_an_index_are_cleaned_once(spark, monkeypatch):
    """The filter on blank pages does not clean them again, and blank or missing pages leave no chunk."""
    import quire.streaming.indexing as module

    seen, real = [], module.chunk_papers
    monkeypatch.setattr(module, "chunk_papers", lambda pages, *rules: seen.append(pages) or real(pages, *rules))
    rows = [("p", 1, "1 Introduction\nTwo  blanks, a bro-\nken word ∑"), ("q", 1, " \n "), ("r", 1, None)]
    made = module.index_pages(spark.createDataFrame(rows, "paper_id string, page bigint, text string").repartition(2))
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["paper_id"], r["text"]) for r in made.collect()] == [("p", "1 Introduction\nTwo blanks, a broken word $\\sum$")]
