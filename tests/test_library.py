import math
import os
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import captured, ledger
from quire.operators.store import Edit, Keyed, Store
from quire.streaming.library import LAYOUT, Library, library_stream, page_grids

PAPERS = "paper_id string, n bigint, note string"


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def data_files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("data/**/part-*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"papers": Keyed(PAPERS, buckets=512)}, {"log": "paper_id string, said string"})


def upsert(spark, rows):
    new = spark.createDataFrame(rows, PAPERS)
    return {"papers": Edit(new, lambda now: ledger.upsert(now, new, ["paper_id"]))}


def test_a_small_update_rewrites_few_files(spark, store):
    rows = [(f"p{i}", i, "old") for i in range(300)]
    assert store.apply(0, upsert(spark, rows))
    before = data_files(store.root)
    assert len(before) > 150
    assert store.apply(1, upsert(spark, [("p7", -7, "new"), ("p8", -8, "new"), ("q", 1, "first")]))
    added = {p for p in data_files(store.root) if p not in before}
    assert len(added) <= 3
    assert all(data_files(store.root)[p] == t for p, t in before.items())
    want = sorted([r for r in rows if r[0] not in ("p7", "p8")] + [("p7", -7, "new"), ("p8", -8, "new"), ("q", 1, "first")])
    assert told(store.read("papers")) == want
    assert told(store.one("papers", "p7")) == [("p7", -7, "new")]
    assert len(store.one("papers", "p7").inputFiles()) == 1


def test_readers_see_all_of_a_batch_or_nothing(spark, store):
    store.apply(0, upsert(spark, [("a", 1, "x"), ("b", 2, "y")]), {"log": spark.createDataFrame([("a", "one")], "paper_id string, said string")})
    state = told(store.read("papers")), told(store.read("log"), "paper_id", "said")

    class Stop(Exception):
        pass

    put, store.files.put = store.files.put, lambda *_: (_ for _ in ()).throw(Stop())
    edit = upsert(spark, [("a", 9, "z"), ("c", 3, "w")])
    log = {"log": spark.createDataFrame([("c", "two")], "paper_id string, said string")}
    with pytest.raises(Stop):
        store.apply(1, edit, log)
    assert (told(store.read("papers")), told(store.read("log"), "paper_id", "said")) == state
    store.files.put = put
    assert store.apply(1, edit, log) and not store.apply(1, edit, log) and not store.apply(0, edit, log)
    assert told(store.read("papers")) == [("a", 9, "z"), ("b", 2, "y"), ("c", 3, "w")]
    assert told(store.read("log"), "paper_id", "said") == [("a", "one"), ("c", "two")]


def test_writers_number_their_batches_apart(spark, store):
    assert store.apply(5, upsert(spark, [("a", 1, "x")]), writer="one")
    assert store.apply(0, upsert(spark, [("b", 1, "x")]), writer="two")
    assert not store.apply(5, upsert(spark, [("c", 1, "x")]), writer="one")
    assert told(store.read("papers"), "paper_id") == [("a",), ("b",)]


def test_deleted_keys_and_vacuum(spark, store):
    store.apply(0, upsert(spark, [("a", 1, "x"), ("b", 2, "y")]))
    gone = spark.createDataFrame([("a",)], "paper_id string")
    store.apply(1, {"papers": Edit(gone, lambda now: ledger.delete_papers({"papers": now}, gone)["papers"])})
    assert told(store.read("papers")) == [("b", 2, "y")]
    assert store.vacuum(keep=2) == []
    assert len(store.vacuum(keep=1)) == 1
    assert told(store.read("papers")) == [("b", 2, "y")] and store.one("papers", "a").count() == 0


def test_an_edit_must_keep_to_its_keys(spark, store):
    stray = spark.createDataFrame([(f"s{i}", 1, "x") for i in range(40)], PAPERS)
    with pytest.raises(ValueError, match="does not name"):
        store.apply(0, {"papers": Edit(stray.limit(1), lambda now: stray)})
    assert store.read("papers").count() == 0 and store.read("log").count() == 0


def model(texts):
    if any("poison" in t for t in texts):
        raise RuntimeError("model refused")
    return [[math.nan, 1.0, 1.0] if "nan" in t else [1.0] * (2 if "short" in t else 3) for t in texts], 10 * len(texts)


def test_failures_of_a_model_stay_with_their_rows(spark):
    texts = ["fine one", "some poison", None, "fine two", "nan here", "short here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: r for r in captured.embed_captured(df, "text", model, 3).collect()}
    assert [i for i, r in got.items() if r.error is None] == [0, 3]
    assert got[0].embedding == [1.0] * 3 and got[1].embedding is None
    assert got[1].error == "RuntimeError: model refused" and got[2].error == "text is null"
    assert "finite" in got[4].error and got[5].error == "vector dimension is not 3: 2"
    many = captured.embed_captured(df.filter("i in (0, 3)"), "text", model, 3)
    assert many.agg(F.sum("usage_tokens")).first()[0] == 20
    assert captured.embed_captured(df.limit(0), "text", model, 3).count() == 0


SCHEMA = "paper_id string, page bigint, text string, " + ", ".join(f"{c} {t}" for c, t in LAYOUT.items())
LINES = [(1, 72.0, 400.0, 100.0, 110.0, "Table 2: Results on the tasks")]
EDGES = [(i, "h", 72.0, 400.0, y, y) for i, y in enumerate((115.0, 130.0, 180.0))]
CELLS = [("Model", 75.0, 118.0), ("MNLI", 180.0, 118.0), ("QNLI", 260.0, 118.0), ("Ours", 75.0, 140.0), ("86.7", 180.0, 140.0), ("92.5", 260.0, 140.0), ("Base", 75.0, 160.0), ("80.1", 180.0, 160.0), ("88.0", 260.0, 160.0)]
WORDS = [(x, x + 30.0, top, text) for text, x, top in CELLS]
GRID = (72.0, 300.0, 400.0, 380.0, [["Name", "Value"], ["alpha", "1"], ["beta", "2"]])
BROKEN = (72.0, 400.0, 400.0, 480.0, [["Name", "Value"], None])


def page(paper, n, text, **layout):
    return (paper, n, text, *[layout.get(c) for c in LAYOUT])


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_broken_page_or_grid_leaves_the_others_whole(spark):
    dims = {"width": 500.0, "height": 700.0, "lines": LINES, "edges": EDGES}
    rows = [
        page("a", 1, "t", words=WORDS, grids=[GRID, BROKEN], **dims),
        page("a", 2, "t", words=[*WORDS, (1.0, None, 2.0, "lost")], grids=[GRID], **dims),
        page("b", 1, "t"),
    ]
    found, letters = page_grids(pages(spark, rows))
    by_caption = {r.caption: r.matrix for r in found.collect()}
    assert by_caption["Table 2: Results on the tasks"] == [["Model", "MNLI", "QNLI"], ["Ours", "86.7", "92.5"], ["Base", "80.1", "88.0"]]
    assert GRID[4] in by_caption.values() and len(by_caption) == 2
    assert told(letters) == [("a", 1, "grid", "grid has a null row"), ("a", 2, "page", "words without a place: 1")]


def body(n):
    return f"Opening of paper {n}.\n2 Method\n" + "plain words follow here " * 60


def test_library_stream_commits_all_tables_at_once(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    rows = [page(f"p{i}", n, body(i) + f"page {n}", title=f"Title {i}", grids=[GRID] if n == 1 else None) for i in range(4) for n in (1, 2)]
    rows += [page("bad", 1, body(9) + " poison"), page("blank", 1, "7"), page("odd", 1, body(8), grids=[BROKEN, GRID])]
    pages(spark, rows).repartition(3, "paper_id").write.parquet(f"{folder}/in")
    library = Library(spark, f"{folder}/library", model=model, dim=3, buckets=16)

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        library_stream(source, library, f"{folder}/state").awaitTermination()

    run()
    read = library.store.read
    status = {r.paper_id: r for r in read("papers").collect()}
    assert {k: r.status for k, r in status.items()} == {**{f"p{i}": "completed" for i in range(4)}, "odd": "completed", "bad": "failed", "blank": "failed"}
    assert status["bad"].error_message == "RuntimeError: model refused" and "No extractable text" in status["blank"].error_message
    assert status["p0"].title == "Title 0" and status["p0"].page_count == 2 and status["p0"].chunk_count == read("chunks").filter("paper_id = 'p0'").count()
    assert told(read("tables"), "paper_id", "table_index", "headers") == [(p, 1, ["Name", "Value"]) for p in ("odd", "p0", "p1", "p2", "p3")]
    assert "bad" not in {r.paper_id for r in read("chunks").collect()}
    assert told(read("dead_letters").filter("part = 'grid'"), "paper_id", "error") == [("odd", "grid has a null row")]
    assert read("dead_letters").filter("part = 'chunk'").select("paper_id").distinct().collect()[0][0] == "bad"
    assert told(read("activity"), "paper_id") == [(p,) for p in ("odd", "p0", "p1", "p2", "p3")]
    n = status["p0"].chunk_count
    assert read("activity").filter("paper_id = 'p0'").first().description == f"Indexed Title 0 ({n} chunks, 1 tables)"

    kept = told(read("chunks").filter("paper_id <> 'p1'"), "paper_id", "chunk_index", "text")
    files = data_files(library.store.root)
    again = [page("p1", 1, "A new text for the first paper.", title="New"), page("p2", 1, "now with poison")]
    pages(spark, again).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()
    assert told(read("chunks").filter("paper_id <> 'p1'"), "paper_id", "chunk_index", "text") == kept
    assert [r.text for r in read("chunks").filter("paper_id = 'p1'").collect()] == ["A new text for the first paper."]
    assert read("tables").filter("paper_id = 'p1'").count() == 0 and read("tables").filter("paper_id = 'p2'").count() == 1
    status = {r.paper_id: (r.status, r.title) for r in read("papers").collect()}
    assert status["p1"] == ("completed", "New") and status["p2"] == ("failed", "Title 2")
    assert all(os.stat(p).st_mtime_ns == t for p, t in files.items())
    assert not library.write(pages(spark, again), 0, f"{folder}/state")


def test_pages_of_a_batch_are_cleaned_once(spark, tmp_path, monkeypatch):
    """Cleaned pages are written to the stage, and what reads them neither plans nor runs the clean-up again."""
    import quire.streaming.library as module

    seen, real = [], module.assign_sections
    monkeypatch.setattr(module, "assign_sections", lambda pages: seen.append(pages) or real(pages))
    rows = [("p", 1, "1 Introduction\n  Two\t blanks and a bro-\nken word.\n\n\n\nEnd \u2211"), ("q", 1, " \n ")]
    library = Library(spark, str(tmp_path / uuid.uuid4().hex))
    assert library.write(spark.createDataFrame(rows, "paper_id string, page bigint, text string"), 0)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "regexp_replace" not in plan
    assert told(library.store.read("chunks"), "text") == [("1 Introduction\nTwo blanks and a broken word.\n\nEnd $\\sum$",)]
