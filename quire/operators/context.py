"""Evidence selection under a token budget."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import count_tokens, strip
from quire.operators.scan import first_rows, latest
from quire.operators.search import knn

BUDGET = 6000
AUDIT_BUDGET = 5000
BLOCK_JOINER = "\n\n---\n\n"
PAPER_JOINER = "\n\n===\n\n"
# Which tables an audit wants first.
TABLE_HINTS = "(?iu)hyper|parameter|setting|config|training|learning|batch|optimi|result|ablation|dataset|statistic|split"
NO_CHUNKS = "no indexed chunks: "
NO_TABLES = "No structured tables were extracted from this paper."
# Fewest tokens of a block with its header: "[1]  | page  | x\n" has 17 characters, "[p. | x]\n" has 9.
_HEADED_COST = 5
_EVIDENCE_COST = 3


def text_chars(text: Column) -> Column:
    """Characters that a text takes in a block: what packing needs to know of it."""
    return F.length(strip(F.coalesce(text.cast("string"), F.lit(""))))


def sized(chunks: DataFrame) -> DataFrame:
    """Chunks with the size of their text in its place, so that ranks and budgets never move a text."""
    return chunks.withColumn("text_chars", text_chars(F.col("text"))).drop("text")


def with_texts(kept: DataFrame, texts: DataFrame, on: Sequence[str] = ("paper_id", "chunk_index")) -> DataFrame:
    """The texts of kept rows, joined last. `on` identifies a row of `texts`; a row without a text gets null."""
    named = texts.select(*[F.col(c).alias(f"_on_{c}") for c in on], "text")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return kept.join(named, same, "left").drop(*[f"_on_{c}" for c in on])


def _prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int | str, least: int, short: bool = False) -> DataFrame:
    """Rows in order up to the first whose block would exceed the budget; the first always stays.

    `size` is the number of characters of a row's block, and may use its `ordinal`. `least` is a lower bound of a block's cost. With a constant budget no more than budget / least
    blocks can be kept, so ranks beyond are pruned before any window sees a whole group; a budget that
    comes as a column bounds each group by its own value. Groups that are `short` lists are ranked where they lie.
    """
    if isinstance(budget, int) and not short:
        ranked = first_rows(df, keys, order, max(1, budget // least), "ordinal")
        most = F.lit(budget)
    else:
        most = F.lit(budget) if isinstance(budget, int) else F.col(budget)
        ranked = df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        ranked = ranked.filter((F.col("ordinal") == 1) | (F.col("ordinal") * least <= most))
    ranked = ranked.withColumn("cost", F.ceil(size / 4).cast("bigint"))
    running = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("total", F.sum("cost").over(running))
        .filter((F.col("ordinal") == 1) | (F.col("total") <= most))
        .withColumn("ordinal", F.col("ordinal").cast("bigint"))
    )


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def source_header(ordinal: Column, kind: Column, table_index: Column, name: Column, page: Column, section: Column) -> Column:
    named = F.when(section != "", section)
    table = F.concat(F.lit("] TABLE "), F.coalesce(table_index.cast("string"), F.lit("None")), F.lit(" | "))
    return F.concat(
        F.lit("["), ordinal.cast("string"),
        F.when(kind == "table", table).otherwise(F.lit("] ")),
        name, F.lit(" | page "), page.cast("string"), F.lit(" | "),
        F.when(kind == "table", F.coalesce(named, F.lit("Table"))).otherwise(F.coalesce(named, F.lit("Unknown section"))),
    )


def pack_prefix(
    hits: DataFrame, keys: Sequence[str], order: Sequence[Column], budget: int | str = BUDGET,
    texts: DataFrame | None = None, on: Sequence[str] = ("paper_id", "chunk_index"), short: bool = False,
) -> DataFrame:
    """Numbered blocks with source headers that fit the budget: adds ordinal, block, cost, total.

    `budget` is a number or the name of a column that is constant in each group. Null parts of a hit
    are empty in its block. Hits either hold their `text`, which suits short lists, or only `text_chars`
    (see `sized`); then the texts of the kept hits alone are joined at the end, from `texts`, whose rows
    `on` identifies. Without `texts` such hits get a `header` in place of the block, and `render_context`
    fetches the texts. `short` says that a group is a short list, as the hits of one query in one paper are.
    """
    have = set(hits.columns)
    kind = F.coalesce("kind", F.lit("text")) if "kind" in have else F.lit("text")
    index = F.col("table_index") if "table_index" in have else F.lit(None).cast("bigint")
    header = source_header(F.col("ordinal"), kind, index, _known("paper_name"), _known("page"), _known("section"))
    body = text_chars(F.col("text")) if texts is None and "text" in have else F.col("text_chars")
    packed = _prefix(hits, keys, order, F.length(header) + 1 + body, budget, _HEADED_COST, short)
    if texts is not None:
        packed = with_texts(packed, texts, on)
    elif "text" not in have:
        return packed.withColumn("header", header)
    return packed.withColumn("block", F.concat(header, F.lit("\n"), strip(_known("text"))))


def render_context(
    packed: DataFrame, keys: Sequence[str], joiner: str = BLOCK_JOINER,
    texts: DataFrame | None = None, on: Sequence[str] = ("paper_id", "chunk_index"),
) -> DataFrame:
    """Packed blocks of each group as one text, with the paper's name as title; bounded by the budget.

    Rows that hold a `header` in place of their block take their texts from `texts`, whose rows `on` identifies,
    paper first. That suits groups that share texts, such as one for each of a few queries and paper.
    """
    if texts is not None:
        return _render_shared(packed, keys, joiner, texts, on)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "block")))
    title = [F.min_by("paper_name", "ordinal").alias("title")] if "paper_name" in packed.columns else []
    return packed.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), joiner).alias("context"), F.count("*").alias("n_used"), *title
    )


def _render_shared(packed: DataFrame, keys: Sequence[str], joiner: str, texts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Contexts whose texts are dealt once, by paper, however many groups use them.

    What the groups picked of a paper is one short row. A paper's texts pass by it, those that nobody picked are
    dropped, and the others are gathered in one row per paper, in which all its contexts are made. Keys are wrapped,
    so that a null is a key like any other.
    """
    titled = ["paper_name"] if "paper_name" in packed.columns else []
    pick = F.struct(F.struct(*on[1:]).alias("at"), F.struct(*keys).alias("group"), "ordinal", "header", *titled)
    picks = packed.groupBy(F.struct(on[0]).alias("_paper")).agg(F.collect_list(pick).alias("_picks"))
    named = texts.select(F.struct(on[0]).alias("_paper"), F.struct(*on[1:]).alias("_at"), "text")
    found = named.join(picks, "_paper").select("_paper", "text", F.filter("_picks", lambda p: p["at"] == F.col("_at")).alias("_mine"))
    taken = F.struct("_mine", strip(_known("text")).alias("text"))
    papers = found.filter(F.size("_mine") > 0).groupBy("_paper").agg(F.collect_list(taken).alias("_kept"))
    groups = F.array_distinct(F.flatten(F.transform("_kept", lambda t: F.transform(t["_mine"], lambda p: p["group"]))))

    def blocks(t: Column) -> Column:
        """The blocks that a group makes of a text: one, as long as `on` identifies it."""
        made = lambda p: F.struct(p["ordinal"].alias("ordinal"), F.concat(p["header"], F.lit("\n"), t["text"]).alias("block"), *[p[c].alias(c) for c in titled])
        return F.transform(F.filter(t["_mine"], lambda p: p["group"] == F.col("_group")), made)

    parts = papers.select("_kept", F.explode(groups).alias("_group")).select("_group", F.sort_array(F.flatten(F.transform("_kept", blocks))).alias("_parts"))
    return parts.select(
        "_group.*", F.array_join(F.transform("_parts", lambda b: b["block"]), joiner).alias("context"),
        F.size("_parts").cast("bigint").alias("n_used"), *[F.col("_parts")[0][c].alias("title") for c in titled],
    )


def pack_greedy(
    items: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, budget: int, on: Sequence[str] = ()
) -> DataFrame:
    """Blocks in order, skipping each that does not fit what is left; smaller later ones may still enter.

    Among blocks of equal cost the kept ones come first, and at most budget / cost of them fit. Only
    those can matter, so a group of any size shrinks to a bounded list before it is folded. If the columns
    `on` identify an item, items are chosen by their cost alone and the rest of the kept ones, blocks
    included, is joined at the end; without them whole items are moved.
    """
    if on:
        chosen = pack_greedy(items, keys, order, block, budget).select(*[F.col(c).alias(f"_on_{c}") for c in on], "cost", "ordinal")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
        return items.withColumn("block", F.coalesce(block, F.lit(""))).join(chosen, same).drop(*[f"_on_{c}" for c in on])
    costed = items.withColumn("block", F.coalesce(block, F.lit(""))).withColumn("cost", count_tokens(F.col("block"))).filter(F.col("cost") <= budget)
    free = costed.filter(F.col("cost") == 0)  # blocks without cost always fit
    ranked = first_rows(costed.filter(F.col("cost") > 0), [*keys, "cost"], order, max(1, budget), "_same")
    ranked = ranked.filter(F.col("_same") * F.col("cost") <= budget).drop("_same")
    at = Window.partitionBy(*keys).orderBy(*order)
    ranked = ranked.withColumn("_at", F.row_number().over(at))
    queue = F.array_sort(F.collect_list(F.struct("_at", "cost")))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["total"] + item["cost"] <= budget
        return F.when(
            fits, F.struct((acc["total"] + item["cost"]).alias("total"), F.concat(acc["kept"], F.array(item["_at"])).alias("kept"))
        ).otherwise(acc)

    chosen = ranked.groupBy(*keys).agg(F.aggregate(queue, start, step)["kept"].alias("_kept"))
    chosen = chosen.select(*keys, F.explode("_kept").alias("_at"))
    kept = ranked.join(chosen, [*keys, "_at"]).drop("_at").unionByName(free)
    return kept.withColumn("ordinal", F.row_number().over(at).cast("bigint"))


def table_priority(tables: DataFrame) -> Column:
    hint = F.concat(F.col("caption"), F.array_join(F.coalesce("headers", F.array()), " "))
    return F.when(hint.rlike(TABLE_HINTS), 0).otherwise(1)


def rank_tables(tables: DataFrame) -> DataFrame:
    """Hyperparameter, data and result tables get priority 0; order by (priority, table_index)."""
    return tables.withColumn("priority", table_priority(tables).cast("bigint"))


def select_tables(tables: DataFrame, budget: int = AUDIT_BUDGET // 3, papers: DataFrame | None = None) -> DataFrame:
    """Tables block of an audit prompt: wanted tables first, skipping what does not fit.

    One row for every paper of `papers`, by default of `tables`; one without a fitting table says so.
    """
    head = F.concat(
        F.lit("[Table "), F.col("table_index").cast("string"), F.lit(" | page "), F.col("page").cast("string"), F.lit("] "),
        F.col("caption"), F.lit("\n"), F.col("markdown"),
    )
    packed = pack_greedy(rank_tables(tables), ["paper_id"], [F.col("priority"), F.col("table_index")], head, budget, on=["paper_id", "table_index"])
    made = render_context(packed, ["paper_id"], "\n\n")
    every = (tables if papers is None else papers).select("paper_id").distinct()
    return every.join(made, "paper_id", "left").select("paper_id", F.coalesce("context", F.lit(NO_TABLES)).alias("tables_block"))


def gather_evidence(chunks: DataFrame, queries: DataFrame, budgets: DataFrame | int = AUDIT_BUDGET, per_query: int = 3) -> DataFrame:
    """Best chunks per paper for each audit question, each once, in reading order, within the budget.

    `budgets` is a number or a frame (paper_id, budget); papers it leaves out get AUDIT_BUDGET.
    """
    hits = knn(sized(chunks), queries, per_query, per_paper=True, payload=("page", "section", "text_chars"))
    once = hits.dropDuplicates(["paper_id", "chunk_index"]).drop("query_id", "rank", "score")
    if isinstance(budgets, DataFrame):
        once = once.join(budgets.select("paper_id", F.col("budget").alias("_budget")), "paper_id", "left").fillna(AUDIT_BUDGET, ["_budget"])
    section = F.coalesce(F.when(F.col("section") != "", F.col("section")), F.lit("Unknown"))
    header = F.concat(F.lit("[p."), _known("page"), F.lit(" | "), section, F.lit("]\n"))
    limit = "_budget" if isinstance(budgets, DataFrame) else budgets
    kept = _prefix(once, ["paper_id"], [F.col("chunk_index")], F.length(header) + F.col("text_chars"), limit, _EVIDENCE_COST)
    block = F.concat(header, strip(_known("text")))
    return with_texts(kept.drop("_budget", "text_chars"), chunks).withColumn("block", block)


def audit_inputs(papers: DataFrame, chunks: DataFrame, tables: DataFrame, questions: DataFrame, budget: int = AUDIT_BUDGET) -> DataFrame:
    """What an audit prompt is filled with, one row per paper: tables_block, context and signals_text, or a reason.

    Tables come first and may take a third of the budget; evidence gets what they leave. Signals are
    counted over the chunks and the tables. A paper without chunks cannot be audited and says so.
    """
    from quire.operators.signals import as_texts, scan_signals, signals_summary

    blocks = select_tables(tables, budget // 3, papers)
    left = blocks.select("paper_id", (F.lit(budget) - count_tokens(F.col("tables_block"))).alias("budget"))
    evidence = render_context(gather_evidence(chunks, questions, left), ["paper_id"]).select("paper_id", "context")
    said = signals_summary(scan_signals(as_texts(chunks, tables))).select("paper_id", "signals_text")
    every = papers.select("paper_id").distinct().join(blocks, "paper_id", "left").join(evidence, "paper_id", "left").join(said, "paper_id", "left")
    none = F.when(F.col("context").isNull(), F.concat(F.lit(NO_CHUNKS), F.col("paper_id").cast("string")))
    return every.withColumn("reason", none)


def sample_evenly(chunks: DataFrame, count: int = 12) -> DataFrame:
    """Chunks spread over each paper, `count` at most. Chunk numbers are dense from 0.

    The wanted numbers follow from the paper's size alone, so chunks are picked by key and no paper
    is sorted.
    """
    sizes = chunks.groupBy("paper_id").agg((F.max("chunk_index") + 1).alias("_n"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") / F.lit(float(count)))).cast("bigint"))
    wanted = F.when(F.col("_n") <= count, F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)).otherwise(spots)
    picks = sizes.select("paper_id", F.explode(F.array_distinct(wanted)).alias("chunk_index"))
    return chunks.join(picks, ["paper_id", "chunk_index"], "left_semi")


def dedupe_first(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("paper_id", "chunk_index")) -> DataFrame:
    """The first row of every key by `order`."""
    return latest(df, list(keys), order)


def _asked(requests: DataFrame) -> DataFrame:
    """requests(request_id, paper_ids) to one row per paper with its share of the budget."""
    share = F.floor(F.lit(BUDGET) / F.greatest(F.size("paper_ids"), F.lit(1))).cast("bigint")
    return requests.select("request_id", share.alias("budget"), F.posexplode("paper_ids").alias("_pos", "paper_id"))


def _by_request(requests: DataFrame, asked: DataFrame, chunks: DataFrame, packed: DataFrame, heading: bool) -> DataFrame:
    """One row per request: its context, or the reason why there is none.

    A request that names a paper without chunks is not answered in part; it says which are missing.
    """
    parts = render_context(packed, ["request_id", "_pos"])
    if heading:
        parts = parts.withColumn("context", F.concat(F.lit("## "), "title", F.lit("\n\n"), "context"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "context", "title")))
    text = F.array_join(F.transform(ordered, lambda p: p["context"]), PAPER_JOINER)
    titles = F.array_join(F.transform(ordered, lambda p: p["title"]), "; ")
    made = parts.groupBy("request_id").agg(text.alias("context"), titles.alias("titles"), F.sum("n_used").alias("n_used"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col("paper_id").cast("string").alias("id")))), lambda m: m["id"])
    absent = asked.join(chunks.select("paper_id").distinct(), "paper_id", "left_anti").groupBy("request_id")
    absent = absent.agg(F.concat(F.lit(NO_CHUNKS), F.array_join(names, ", ")).alias("reason"))
    out = requests.select("request_id").distinct().join(made, "request_id", "left").join(absent, "request_id", "left")
    given = lambda c, none: F.when(F.col("reason").isNull(), F.coalesce(c, F.lit(none))).alias(c)
    return out.select("request_id", given("context", ""), *([given("titles", "")] if heading else []), given("n_used", 0), "reason")


def coverage_context(requests: DataFrame, chunks: DataFrame, count: int = 12) -> DataFrame:
    """Context spread over the requested papers, for study material."""
    asked = _asked(requests)
    wanted = sized(chunks.drop("embedding")).join(asked.select("paper_id").distinct(), "paper_id", "left_semi")
    rows = asked.join(sample_evenly(wanted, count), "paper_id")
    packed = pack_prefix(rows, ["request_id", "_pos"], [F.col("chunk_index")], "budget", chunks)
    return _by_request(requests, asked, chunks, packed, heading=False)


def _openers_and_hits(chunks: DataFrame, queries: DataFrame, openers: int, k: int) -> DataFrame:
    """First chunks of each paper and its best chunks per query, each once. Reading order is chunk order."""
    return knn(sized(chunks), queries, k, per_paper=True, payload=("paper_name", "page", "section", "text_chars"), openers=openers).drop("rank", "score")


def focused_context(requests: DataFrame, chunks: DataFrame, query: DataFrame, k: int = 6) -> DataFrame:
    """First chunk and best chunks of each requested paper for one query, grouped by paper."""
    asked = _asked(requests)
    wanted = chunks.join(asked.select("paper_id").distinct(), "paper_id", "left_semi")
    rows = asked.join(_openers_and_hits(wanted, query, 1, k), "paper_id")
    packed = pack_prefix(rows, ["request_id", "_pos"], [F.col("chunk_index")], "budget", chunks)
    return _by_request(requests, asked, chunks, packed, heading=True)


def summary_context(chunks: DataFrame, styles: DataFrame, k: int = 10) -> DataFrame:
    """Context of every paper for every summary style. styles(query_id, embedding): a short fixed list.

    Most styles want the same chunks of a paper, so its texts are moved once and not once per style.
    """
    rows = _openers_and_hits(chunks, styles, 2, k)
    packed = pack_prefix(rows, ["query_id", "paper_id"], [F.col("chunk_index")], BUDGET, short=True)
    return render_context(packed, ["query_id", "paper_id"], texts=chunks)


def split_answerable(questions: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions with evidence, questions without)."""
    found = hits.select("query_id").distinct()
    return questions.join(found, "query_id", "left_semi"), questions.join(found, "query_id", "left_anti")
