import datetime
import time
import uuid

from pyspark.sql import functions as F

from quire.operators import citations, ledger as L, replies
from quire.streaming import events as E
from quire.streaming.indexing import Sink, index_pages, index_stream


def parsed(spark, reply, **columns):
    good, bad = replies.parse_replies(spark.createDataFrame([(reply,)], "reply string"))
    return good.withColumns({k: F.lit(v) for k, v in columns.items()}), bad


def test_replies(spark):
    quiz = '{"questions": [{"question": "Q?", "options": ["Attention", "Recurrence", "Convolution", "Trees"], "answer": "c", "explanation": "See."}, {"question": "", "answer": "x"}]}'
    q = replies.normalize_questions(parsed(spark, quiz, quiz_type="mcq", count=5)[0]).first()["questions"]
    assert len(q) == 1 and q[0]["answer"] == "Convolution"
    gaps = '```json\n{"gaps": [{"title": "Small", "confidence": "HIGH", "papers": ["A"]}]}\n```'
    g = replies.normalize_gaps(parsed(spark, gaps)[0]).first()["gaps"]
    assert g[0]["confidence"] == "high" and g[0]["category"] == "future_work" and g[0]["papers"] == ["A"]
    cards = 'Sure: {"cards": [{"front": "F", "back": "B", "explanation": ""}, {"front": "only"}]} done'
    c = replies.normalize_cards(parsed(spark, cards, count=8)[0]).first()["cards"]
    assert len(c) == 1 and c[0]["explanation"] is None
    good, bad = parsed(spark, "no json {")
    assert good.count() == 0 and bad.count() == 1


def test_cell_citations(spark):
    answers = spark.createDataFrame([("a", "p", 'x [1] (Table 2, row "Ours", column "F1") and (table IV, row “no”, col ‘x’)')], "answer_id string, paper_id string, answer string")
    tables = spark.createDataFrame([("p", 7, "Table 2: R", ["Model", "Max F1", "**F1**"], [["Base", "1", "2"], ["Ours", "3", "4"], ["Ours (no attn)", "5", "6"]])],
                                   "paper_id string, table_index int, caption string, headers array<string>, rows array<array<string>>")
    hit, lost = citations.resolve_cells(citations.cell_references(answers), tables)
    assert sorted((r["row_no"], r["col_no"]) for r in hit.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert [r["table_no"] for r in lost.collect()] == ["IV"]


def test_cell_citations_match_labels_before_copies_meet(spark):
    """Copies of answers and tables meet by what their labels hit; no label is compared once per pair of copies."""
    text = 'x (Table 2, row "Ours", column "F1"), (Table 2, row "Base", column "no")'
    answers = spark.range(30).selectExpr("id AS answer_id", "'p' AS paper_id", f"'{text}' AS answer")
    tables = spark.range(40).selectExpr("'p' AS paper_id", "id + 100 AS table_index", "'Table 2' AS caption", "array('M', 'F1') AS headers", "array(array('Ours', '1'), array(NULL, '2'), NULL) AS rows")
    tables = tables.union(tables.filter("table_index = 100"))
    hit, lost = citations.resolve_cells(citations.cell_references(answers), tables)
    assert hit.count() == 30 * 41 and hit.distinct().count() == 30 * 40
    assert sorted({(r["ref_no"], r["row_no"], r["col_no"]) for r in hit.collect()}) == [(1, 0, 1)]
    assert sorted((r["answer_id"], r["ref_no"]) for r in lost.collect()) == [(i, 2) for i in range(30)]
    top = hit._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "regexp_replace" not in top and "lambda" not in top


def test_ledger_rules(spark):
    papers = spark.createDataFrame([("a", "A", "completed"), ("b", "B", "indexing")], "paper_id string, title string, status string")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["x", "b"]), (4, [])], "request_id int, paper_ids array<string>")
    got = {r["request_id"]: (r["ready"], r["code"]) for r in L.check_ready(asked, papers).collect()}
    assert got == {1: (True, None), 2: (False, 409), 3: (False, 404), 4: (True, None)}
    target = spark.createDataFrame([("a", 0, "old"), ("b", 0, "keep")], "paper_id string, chunk_index int, text string")
    fresh = spark.createDataFrame([("a", 0, "new"), ("a", 1, "more")], target.schema)
    once = L.upsert(target, fresh, ["paper_id", "chunk_index"])
    assert once.count() == 3 and L.upsert(once, fresh, ["paper_id", "chunk_index"]).count() == 3
    gone = L.delete_papers({"papers": papers, "qa_logs": papers, "activity": spark.createDataFrame([("a",), (None,)], "paper_id string")}, papers.filter("paper_id = 'a'"))
    assert {k: v.count() for k, v in gone.items()} == {"papers": 1, "qa_logs": 2, "activity": 1}
    hits, misses = L.cache_split(spark.createDataFrame([("a", False), ("b", True), ("c", None)], "paper_id string, refresh boolean"), papers, ["paper_id"])
    assert [r[0] for r in hits.collect()] == ["a"] and sorted(r[0] for r in misses.collect()) == ["b", "c"]


def test_stream_index_equals_batch_and_replaces(spark, tmp_path):
    rows = [(f"p{i}", p, f"Header line\n{p} Results\nText of paper {i} on page {p}. " + "word " * 300 + f"\n{p}") for i in range(6) for p in range(1, 5)] + [("blank", 1, "7")]
    pages = spark.createDataFrame(rows, "paper_id string, page int, text string")
    folder = str(tmp_path / uuid.uuid4().hex)
    pages.repartition(3, "paper_id").write.parquet(f"{folder}/in")
    sink = Sink(f"{folder}/chunks", f"{folder}/out")

    def run():
        source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        index_stream(source, sink, f"{folder}/state").awaitTermination()
        return sorted((r["paper_id"], r["chunk_index"], r["text"], r["section"]) for r in sink.current(spark).collect())

    batch = sorted((r["paper_id"], r["chunk_index"], r["text"], r["section"]) for r in index_pages(pages).collect())
    assert run() == batch
    pages.filter("paper_id = 'p1'").withColumn("text", F.concat(F.lit("Fresh text of page "), F.col("page").cast("string"), F.lit("."))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    after = run()
    assert [r[2] for r in after if r[0] == "p1"] == [f"Fresh text of page {n}." for n in range(1, 5)]
    assert [r for r in after if r[0] != "p1"] == [r for r in batch if r[0] != "p1"]
    outcome = {r["paper_id"]: r for r in sink.papers(spark).collect()}
    assert not outcome["blank"]["ok"] and outcome["blank"]["error"] and outcome["p0"]["ok"]


def _stream_answers(spark, folder, batches, **options):
    """Answers and progress of a stream that reads one file per batch."""
    schema = "answer_id string, seq bigint, type string, text string, at timestamp"
    for part in batches:
        spark.createDataFrame([(*r[:4], datetime.datetime(2025, 1, 1, r[4] if len(r) > 4 else 0)) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are read in the order of their times
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = E.assemble_stream(source, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    with E.listed_state(spark):
        run = made.trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted(map(tuple, spark.read.schema("answer_id string, answer string, n_tokens bigint").parquet(f"{folder}/out").collect()), key=str), run.recentProgress


def test_event_stream_out_of_order(spark, tmp_path):
    before = spark.conf.get(E.STATE_KEY, None)
    got, _ = _stream_answers(spark, tmp_path, [
        [("x", 0, "meta", ""), ("x", 2, "token", "answer "), ("y", 0, "meta", ""), ("x", 4, "done", ""), (None, 1, "done", None)],
        [("x", 1, "token", "Streamed "), ("x", 3, "token", "[1]"), ("y", 1, "token", "a"), (None, 0, "token", None), ("x", None, "token", "lost")],
    ])
    assert got == [("x", "Streamed answer [1]", 3)]
    assert spark.conf.get(E.STATE_KEY, None) == before


def test_events_sent_again_change_nothing_and_only_new_ones_are_written(spark, tmp_path):
    first = [("x", i, "token", f"w{i} ") for i in range(400)]
    got, progress = _stream_answers(spark, tmp_path, [first, first[:3], [("x", 401, "done", "")], [("x", 400, "token", "end")], [("x", 400, "token", "end"), ("x", 401, "done", "")]])
    assert got == [("x", "".join(r[3] for r in first) + "end", 401)]
    written = [p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"] for p in progress if p["numInputRows"]]
    # The third batch meets repeated events beside the done event, and leaves each once.
    assert len(written) == 5 and all(5 * written[n] < written[0] for n in (1, 3, 4)), written


def test_answers_without_end_are_given_up(spark, tmp_path):
    got, progress = _stream_answers(spark, tmp_path, [
        [("x", 0, "token", "early", 0), ("y", 0, "token", "kept", 9)],
        [("z", 0, "meta", "", 10)],
        [("x", 1, "done", "", 10), ("y", 1, "done", "", 10)],
    ], patience="2 hours", at="at")
    assert got == [("y", "kept", 1)]


def test_one_row_per_key_whatever_the_changes(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "paper_id string, n int, note string")
    twice = spark.createDataFrame([("a", 5, "p"), ("a", 7, "q"), ("c", 1, None)], target.schema)
    assert sorted(map(tuple, L.upsert(target, twice, ["paper_id"]).collect())) == [("a", 7, "q"), ("b", 2, "y"), ("c", 1, None)]
    changes = spark.createDataFrame([("a", 3, None, 1), ("a", None, "new", 2), ("a", 4, None, 3)], "paper_id string, n int, note string, at int")
    got = L.update_by_key(target, changes.drop("at").withColumn("note", F.col("note")), newest=None)
    assert sorted(map(tuple, got.collect())) == [("a", 4, "new"), ("b", 2, "y")]
    nulls = spark.createDataFrame([("a", None, None, ["note"]), ("b", 9, "gone", ["n"])], "paper_id string, n int, note string, changed array<string>")
    assert sorted(map(tuple, L.update_by_key(target, nulls).collect())) == [("a", 1, None), ("b", 9, "y")]


def test_the_kept_side_of_a_ledger_is_dealt_into_the_partitions_asked_for(spark):
    """Spark does not join the partitions of such a shuffle, so a task holds its share and no more."""
    n = 7
    asked = spark.createDataFrame([(i, i % 3 == 0) for i in range(50)] + [(None, False)], "paper_id int, refresh boolean")
    cache = spark.createDataFrame([(i % 20,) for i in range(60)] + [(None,)], "paper_id int")
    hits, misses = L.cache_split(asked, cache, ["paper_id"], n)
    assert sorted(r[0] for r in hits.collect()) == [i for i in range(20) if i % 3]
    assert sorted(map(tuple, hits.unionByName(misses).collect()), key=str) == sorted(map(tuple, asked.collect()), key=str)
    papers = spark.createDataFrame([(i, "t", "indexing", None, 0) for i in range(50)], "paper_id int, title string, status string, error_message string, page_count int")
    outcomes = spark.createDataFrame([(i, i % 2 == 0, "broken", "T", 3) for i in range(40)], "paper_id int, ok boolean, error string, title string, page_count int")
    done = L.apply_index_outcome(papers, outcomes.repartition(n, "paper_id"), n)
    assert sorted(done.collect()) == sorted(L.apply_index_outcome(papers, outcomes).collect())
    assert [df.rdd.getNumPartitions() for df in (misses, done)] == [n, n]
    plan = misses._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_outcomes_of_one_paper_leave_one_row(spark):
    papers = spark.createDataFrame([("a", "t", "indexing", None, 0, 0, None, None)], "paper_id string, title string, status string, error_message string, page_count int, chunk_count int, authors string, abstract string")
    fields = "paper_id string, ok boolean, error string, title string, page_count int, chunk_count int, authors string, abstract string"
    good = ("a", True, None, "T", 3, 9, "Ann, Bo", "Short.")
    row = L.apply_index_outcome(papers, spark.createDataFrame([good, good], fields)).collect()
    assert [tuple(r) for r in row] == [("a", "T", "completed", None, 3, 9, "Ann, Bo", "Short.")]
    mixed = L.apply_index_outcome(papers, spark.createDataFrame([good, ("a", False, "broken", None, None, None, None, None)], fields)).collect()
    assert [(r["status"], r["error_message"]) for r in mixed] == [("failed", "broken")]


def test_a_paper_may_arrive_in_several_batches(spark, tmp_path):
    pages = spark.createDataFrame([("p", i, f"Part {i} of the log.\n2 Voyage\nRow {i}", 1) for i in range(1, 7)], "paper_id string, page bigint, text string, upload int")
    sink = Sink(f"{tmp_path}/chunks", f"{tmp_path}/outcomes", f"{tmp_path}/pages")
    for n, part in enumerate((pages.filter("page > 4"), pages.filter("page <= 2"), pages.filter("page in (3, 4)"))):
        sink.write(part, n)
    whole = lambda df: sorted((r["chunk_index"], r["page"], r["section"], r["text"]) for r in df.collect())
    assert whole(sink.current(spark)) == whole(index_pages(pages.drop("upload")))
    sink.write(spark.createDataFrame([("p", 1, "A new log.", 2)], pages.schema), 3)
    assert [r[3] for r in whole(sink.current(spark))] == ["A new log."]


def test_questions_of_a_reply_are_made_once(spark, tmp_path):
    """Each field of a question is read once, no filter makes the questions again, and replies without one leave no row."""
    from quire.plans.study import normalize_questions

    parts = [(i, "Ship", "Brand#1", "Tall", 4 if i == 12 else 1) for i in (3, 4, 6, 12)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    made = normalize_questions(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"$.{f}, ") for f in ("question", "answer", "options", "explanation")] == [1, 1, 1, 1]
    assert sorted((r["reply_id"], r["item_no"], r["answer"]) for r in made.collect()) == [(4, 1, "False"), (4, 2, "True"), (6, 1, "Brand#1 x")]
