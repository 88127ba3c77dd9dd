import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quire.operators import context as C, embedding as E, search


def test_hash_embed(spark):
    texts = ["Lamp oil, rope and lamp glass", "", "the the THE cat", "é ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.hash_embed(F.col("t")).alias("v"))
    for r in df.collect():
        want = [0.0] * 256
        for w in re.findall("[a-z]{3,}", r["t"].lower()):
            want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 256] = 1.0
        norm = math.sqrt(sum(want)) or 1.0
        assert np.allclose(r["v"], [x / norm for x in want]) and len(r["v"]) == 256


def brute(rows, queries, k, per_paper):
    out = []
    for q, qv in queries:
        scored = []
        for p, i, v in rows:
            s = float(np.dot(v, qv)) / ((np.linalg.norm(v) or 1) * (np.linalg.norm(qv) or 1))
            scored.append((p if per_paper else "", -round(s, 9) + 0.0, p, i))
        scored.sort()
        seen = {}
        for g, _, p, i in scored:
            seen[g] = seen.get(g, 0) + 1
            if seen[g] <= k:
                out.append((q, p, i, seen[g]))
    return sorted(out)


def test_knn_equals_brute_force_with_copies_filters_and_many_passes(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(-3, 4, (40, 8)).astype(float)
    # A third of all rows are copies of one vector, all in one paper.
    rows = [("hot" if i % 3 == 0 else f"p{i % 5}", i, (pool[0] if i % 3 == 0 else pool[i % 40]).tolist()) for i in range(300)]
    queries = [(q, pool[q].tolist()) for q in range(12)] + [(99, [0.0] * 8)]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_index int, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    for per_paper in (False, True):
        for block in (8192, 3):
            got = search.knn(chunks, asked, 4, per_paper=per_paper, block=block).select("query_id", "paper_id", "chunk_index", "rank")
            assert sorted(map(tuple, got.collect())) == brute(rows, queries, 4, per_paper)
    own = asked.withColumn("paper_ids", F.array(F.lit("p1")))
    assert {r["paper_id"] for r in search.knn(chunks, own, 2).collect()} == {"p1"}
    assert search.knn(chunks, asked, 2, papers=["other"]).count() == 0
    assert search.knn(chunks, asked, 2, papers=[]).count() == 2 * len(queries)


def test_restricted_queries_meet_their_papers_only():
    class Counted(np.ndarray):
        rows = 0

        def __matmul__(self, other):
            Counted.rows += len(self)
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(5)
    vectors, papers = rng.normal(size=(60, 4)), np.array([f"p{i % 6}" for i in range(60)], object)
    matrix, allowed = rng.normal(size=(3, 4)), [{"p1"}, {"p2", "p5", "none"}, {"none"}]
    at, query, value = search._best(vectors.view(Counted), matrix, [papers, np.arange(60)], None, allowed, papers, 5, None)
    assert Counted.rows == 10 + 20
    for q in range(3):
        own = [i for i in range(60) if papers[i] in allowed[q]]
        cosine = {i: vectors[i] @ matrix[q] / np.linalg.norm(vectors[i]) / np.linalg.norm(matrix[q]) for i in own}
        assert sorted(at[query == q]) == sorted(sorted(own, key=lambda i: -cosine[i])[:5])


def test_queries_with_one_id_share_their_places(spark):
    chunks = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(6)], "paper_id string, chunk_index int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, float(n)]) for n in range(20)], "query_id int, embedding array<double>").repartition(4)
    got = search.knn(chunks, asked, 3, block=4)
    assert got.count() == 3 and got.agg(F.max("rank")).first()[0] == 3


def test_needs_tables(one):
    assert one(search.needs_tables, "Which accuracy has the gauge?", "Compare both quays", "Who built the lighthouse?", "Over 3 winters") == [True, True, False, True]


HITS = "query_id int, position int, kind string, table_index bigint, paper_name string, page int, section string, text string"


def test_pack_prefix_budget_and_headers(spark):
    hits = spark.createDataFrame([(1, i, "text", None, "P", i, "S", "x" * 400) for i in range(10)] + [(2, 0, "table", 3, "P", 4, "Table 3: Depths", "| a | b |")], HITS)
    packed = C.pack_prefix(hits, ["query_id"], [F.col("position")], 250)
    made = {r["query_id"]: r for r in C.render_context(packed, ["query_id"]).collect()}
    assert made[1]["n_used"] == 2 and made[1]["context"].startswith("[1] P | page 0 | S")
    assert made[2]["context"].startswith("[1] TABLE 3 | P | page 4 | Table 3: Depths")
    big = C.pack_prefix(hits, ["query_id"], [F.col("position")], 10)
    assert big.filter("query_id = 1").count() == 1


def test_pack_greedy_equals_the_plain_loop(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"k{i % 4}", i, "y" * (4 * rng.randint(1, 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    want = []
    for key in {r[0] for r in rows}:
        total, n = 0, 0
        for _, o, t in sorted(r for r in rows if r[0] == key):
            if total + len(t) // 4 <= 100:
                total, n = total + len(t) // 4, n + 1
                want.append((key, o, n))
    got = C.pack_greedy(df, ["k"], [F.col("o")], F.col("t"), 100).select("k", "o", "ordinal")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sample_evenly(spark):
    df = spark.createDataFrame([(p, i) for p, n in (("a", 5), ("b", 40), ("c", 12)) for i in range(n)], "paper_id string, chunk_index int")
    got = {}
    for r in C.sample_evenly(df, 12).collect():
        got.setdefault(r["paper_id"], set()).add(r["chunk_index"])
    assert got == {"a": set(range(5)), "b": {int(i * (40 / 12)) for i in range(12)}, "c": set(range(12))}


def test_no_evidence_is_split_off(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    yes, no = C.split_answerable(asked, spark.createDataFrame([(1,), (1,)], "query_id int"))
    assert [r[0] for r in yes.collect()] == [1] and [r[0] for r in no.collect()] == [2]


def test_hits_of_a_question_are_never_cut(spark):
    hits = spark.range(1500).select(
        F.lit(1).alias("query_id"), F.when(F.col("id") % 2 == 0, "text").otherwise("table").alias("kind"),
        (F.col("id") + 1).cast("int").alias("rank"), F.lit("p").alias("paper_id"), F.col("id").alias("chunk_index"),
    )
    got = [(r["kind"], r["rank"]) for r in search.order_hits(hits).orderBy("position").collect()]
    want = sorted(((("text", "table")[i % 2], i + 1) for i in range(1500)), key=lambda x: (x[0] == "table", x[1]))
    assert got == want


def test_blocks_without_cost_all_stay(spark):
    rows = [("a", i, "" if i % 4 else "w" * 40) for i in range(400)]
    got = C.pack_greedy(spark.createDataFrame(rows, "k string, o int, t string"), ["k"], [F.col("o")], F.col("t"), 100)
    kept = [r["o"] for r in got.orderBy("ordinal").collect()]
    assert kept == [i for i in range(400) if i % 4 or i < 40]


def test_a_budget_column_bounds_each_group_by_its_own_value(spark):
    rows = [(q, i, "P", i % 9, "S", "t", 100_000 if q == 1 else 50) for q in (1, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "query_id int, position int, paper_name string, page int, section string, text string, budget bigint")
    got = {r["query_id"]: r["n"] for r in C.pack_prefix(df, ["query_id"], [F.col("position")], "budget").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    costs = [-(-len(f"[{i + 1}] P | page {i % 9} | S\nt") // 4) for i in range(3000)]
    want = {1: 3000, 2: sum(1 for i in range(3000) if sum(costs[: i + 1]) <= 50)}
    assert got == want


def test_null_parts_of_a_hit_are_empty(spark):
    row = C.pack_prefix(spark.createDataFrame([(1, 0, None, None, None, None)], "query_id int, position int, paper_name string, page int, section string, text string"), ["query_id"], [F.col("position")]).first()
    assert row["block"] == "[1]  | page  | Unknown section\n" and row["cost"] == 8


def test_requests_say_which_papers_are_missing(spark):
    chunks = spark.createDataFrame([("a", 0, "A", 1, "S", "one", [1.0]), ("b", 0, "B", 2, "S", "two", [0.5])], "paper_id string, chunk_index bigint, paper_name string, page int, section string, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zz"]), (3, ["zz", "y"]), (4, [])], "request_id int, paper_ids array<string>")
    ask = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    for frame in (C.coverage_context(asked, chunks), C.focused_context(asked, chunks, ask)):
        got = {r["request_id"]: r for r in frame.collect()}
        assert [got[i]["reason"] for i in (1, 2, 3, 4)] == [None, "no indexed chunks: zz", "no indexed chunks: zz, y", None]
        assert "one" in got[1]["context"] and "two" in got[1]["context"] and got[1]["n_used"] == 2
        assert [got[i]["context"] for i in (2, 3, 4)] == [None, None, ""]


def test_papers_whose_tables_do_not_fit_say_so(spark):
    rows = [("a", 1, 1, "Small", ["h"], "| x |"), ("b", 1, 1, "Large", ["h"], "y" * 9000)]
    tables = spark.createDataFrame(rows, "paper_id string, table_index bigint, page int, caption string, headers array<string>, markdown string")
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    got = {r["paper_id"]: r["tables_block"] for r in C.select_tables(tables, papers=papers).collect()}
    assert got == {"a": "[Table 1 | page 1] Small\n| x |", "b": C.NO_TABLES, "c": C.NO_TABLES}


def test_rows_without_a_vector_take_no_part(spark):
    chunks = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, None)], "paper_id string, chunk_index bigint, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, embedding array<double>")
    assert [r["chunk_index"] for r in search.knn(chunks, ask, 5).collect()] == [0]


def _moved(df, column):
    """How many exchanges of a plan that has not run carry a column of this name."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*?)\]", plan)
    return sum(bool(re.search(rf"\b{column}#\d+", i)) for i in inputs)


def test_texts_meet_only_the_kept(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else None, i, f"P{i % 2}", i % 7, None if i % 5 == 0 else "S", None if i % 11 == 0 else " w" * rng.randint(0, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "paper_id string, chunk_index int, paper_name string, page int, section string, text string")
    order = [F.desc("chunk_index")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = ["paper_id", "chunk_index", "ordinal", "cost", "total", "block"]
        whole = C.pack_prefix(df, ["paper_id"], order, 400).select(*columns)
        late = C.pack_prefix(C.sized(df), ["paper_id"], order, 400, df).select(*columns)
        assert _moved(late, "text") == 1
        assert sorted(map(str, late.collect())) == sorted(map(str, whole.collect()))
        columns = ["paper_id", "chunk_index", "ordinal", "cost", "block", "page"]
        whole = C.pack_greedy(df, ["paper_id"], order, F.col("text"), 100).select(*columns)
        late = C.pack_greedy(df, ["paper_id"], order, F.col("text"), 100, ["paper_id", "chunk_index"]).select(*columns)
        both = lambda f: _moved(f, "text") + _moved(f, "block")
        assert both(late) < both(whole) and _moved(late, "block") <= 1
        assert sorted(map(str, late.collect())) == sorted(map(str, whole.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_are_worked_out_once(spark):
    """A vector that is an expression is not worked out again to see whether it is null."""
    rows = [(p, i, t) for p in ("a", "b") for i, t in enumerate(("rope and lamp", None, "lamp glass", "lamp oil"))]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_index long, text string").repartition(2)
    chunks = chunks.withColumn("embedding", F.when(F.col("text").isNotNull(), E.hash_embed(F.col("text"))))
    asked = spark.createDataFrame([("q", "lamp")], "query_id string, text string").select("query_id", E.hash_embed(F.col("text")).alias("embedding"))
    hits = search.knn(chunks, asked, 2, per_paper=True)
    plan = hits._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("md5(" in line for line in plan) == 1
    assert sorted((r["paper_id"], r["chunk_index"], r["rank"]) for r in hits.collect()) == [(p, i, n) for p in ("a", "b") for i, n in ((2, 1), (3, 2))]
    opened = search.knn(chunks, asked, 2, per_paper=True, openers=2).collect()
    assert sorted((r["paper_id"], r["chunk_index"]) for r in opened) == [(p, i) for p in ("a", "b") for i in (0, 2, 3)]


def _dealt_bytes(node):
    """Bytes of all shuffles of a plan that has run."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _dealt_bytes(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return _dealt_bytes(node.plan())
    own = node.metrics().get("dataSize").get().value() if node.nodeName() == "Exchange" else 0
    return own + sum(_dealt_bytes(node.children().apply(i)) for i in range(node.children().size()))


def test_a_text_is_moved_once_for_all_summary_styles(spark):
    rng = np.random.default_rng(6)
    sizes = {-1: 9, 1: 1, 2: 2, 3: 14}  # -1 stands for a paper without an id
    vectors = [(p, i, rng.normal(size=8)) for p, n in sizes.items() for i in range(n)]
    asked = [(f"s{i}", rng.normal(size=8)) for i in range(8)]
    text = {(p, i): "" if (p, i) == (2, 1) else f"{p} {i} " + "w" * 2000 + f" {i} " + "x" * (25000 if (p, i) == (-1, 0) else 0) for p, i, _ in vectors}
    rows = [(None if p < 0 else p, i, f"P{p}", i + 1, "" if i % 2 else "S", text[p, i] + " \n", v.tolist()) for p, i, v in vectors]
    chunks = spark.createDataFrame(rows, "paper_id bigint, chunk_index bigint, paper_name string, page int, section string, text string, embedding array<double>")
    styles = spark.createDataFrame([(s, v.tolist()) for s, v in asked], "query_id string, embedding array<double>")
    hits = {(s, p, i) for s, p, i, _ in brute(vectors, asked, 4, True)}
    want = {}
    for s, _ in asked:
        for p, n in sizes.items():
            blocks, total = [], 0
            for i in (i for i in range(n) if i < 2 or (s, p, i) in hits):
                made = f"[{len(blocks) + 1}] P{p} | page {i + 1} | {'Unknown section' if i % 2 else 'S'}\n{text[p, i].strip()}"
                total += -(-len(made) // 4)
                if blocks and total > C.BUDGET:
                    break
                blocks.append(made)
            want[s, None if p < 0 else p] = (C.BLOCK_JOINER.join(blocks), len(blocks), f"P{p}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = C.summary_context(chunks, styles, 4)
        got = {(r["query_id"], r["paper_id"]): (r["context"], r["n_used"], r["title"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    whole = sum(map(len, text.values()))
    assert whole <= _dealt_bytes(made._jdf.queryExecution().executedPlan()) < 2 * whole


def test_openers_leave_with_the_hits(spark):
    """No second reading of the rows, and no second vector, for the first chunks of a paper."""
    chunks = spark.createDataFrame([(p, i, f"lamp {i} rope"[: 4 + i]) for p in ("a", "b") for i in range(5)], "paper_id string, chunk_index bigint, text string")
    chunks = chunks.withColumn("embedding", E.hash_embed(F.col("text")))
    asked = spark.createDataFrame([("q", "rope"), ("r", "lamp")], "query_id string, text string").select("query_id", E.hash_embed(F.col("text")).alias("embedding"))
    for per_paper, k in ((True, 2), (False, 3)):
        opened = search.knn(chunks, asked, k, per_paper=per_paper, openers=2)
        assert sum("md5(" in line for line in opened._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 1
        best = {(r["query_id"], r["paper_id"], r["chunk_index"]): (r["score"], r["rank"]) for r in search.knn(chunks, asked, k, per_paper=per_paper).collect()}
        want = {key: found for key, found in best.items() if key[2] >= 2} | {(q, p, i): (None, None) for q in "qr" for p in "ab" for i in (0, 1)}
        got = opened.collect()
        assert {(r["query_id"], r["paper_id"], r["chunk_index"]): (r["score"], r["rank"]) for r in got} == want and len(got) == len(want)
