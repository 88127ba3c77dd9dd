"""The record tables: papers, tables, summaries, audits, questions, activity.

Each operator maps tables to their next state; the caller writes it. Changes are matched by key with
semi, anti and left joins, which Spark broadcasts when the changed side is measured to be small and
splits when a key is hot. Where `n_parts` can be given, rows are dealt by key into so many partitions (`session.parts`) before they
are hashed or sorted, so that the memory of a task does not grow with the tables. Outcomes come dealt by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scan import latest

# Limits and vocabularies of requests and records.
MAX_TITLE = 300
MAX_ERROR = 500
MAX_QUESTION = 2000
DIFFICULTIES = ("easy", "medium", "hard")
QUIZ_TYPES = ("mcq", "true_false", "short_answer")
STYLES = ("abstract", "methodology", "results", "conclusion", "beginner", "technical", "bullet", "one-page")
MAX_QUIZ, MAX_CARDS = 15, 20
STUDY_EVENTS = ("quiz", "flashcards")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], newest: Sequence[Column] | None = None) -> DataFrame:
    """Rows of `updates` replace rows with the same key; the result has one row per updated key.

    `newest` orders several updates of one key, first wins; without it the largest row by value wins.
    """
    keys = list(keys)
    others = [c for c in updates.columns if c not in keys]
    order = newest or [F.desc(F.struct(*others))] if others else [F.lit(1)]
    fresh = latest(updates, keys, order)
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*target.columns))


def replace_group(target: DataFrame, new: DataFrame, key: str = "paper_id", groups: DataFrame | None = None) -> DataFrame:
    """All rows of the replaced keys go; `groups` also names keys whose new set is empty."""
    replaced = (new if groups is None else groups).select(key).distinct()
    return target.join(replaced, key, "left_anti").unionByName(new.select(*target.columns))


def delete_papers(ledger: Mapping[str, DataFrame], ids: DataFrame, kept: Sequence[str] = ("qa_logs",)) -> dict[str, DataFrame]:
    """Remove papers from every table that has their id; question logs stay.

    Activity without a paper (paper_id null) stays as well.
    """
    gone = ids.select("paper_id").distinct()
    return {n: t if n in kept else t.join(gone, "paper_id", "left_anti") for n, t in ledger.items()}


def activity_of_questions(qa: DataFrame) -> DataFrame:
    """Activity rows of logged questions; the paper is named only when exactly one was asked."""
    return qa.select(
        F.lit("qa").alias("event_type"),
        F.concat(F.lit("Asked: "), F.left("question", F.lit(80))).alias("description"),
        F.when(F.size("paper_ids") == 1, F.try_element_at("paper_ids", F.lit(1))).alias("paper_id"),
        "created_at",
    )


def activity_of_outcomes(outcomes: DataFrame) -> DataFrame:
    """Activity rows of papers that were indexed: title, chunks, and tables if there are any.

    outcomes(paper_id, ok, title, chunk_count, table_count, created_at)
    """
    tables = F.when(F.col("table_count") > 0, F.concat(F.lit(", "), F.col("table_count").cast("string"), F.lit(" tables"))).otherwise("")
    said = F.concat(F.lit("Indexed "), F.left("title", F.lit(80)), F.lit(" ("), F.col("chunk_count").cast("string"), F.lit(" chunks"), tables, F.lit(")"))
    return outcomes.filter("ok").select(F.lit("indexed").alias("event_type"), said.alias("description"), "paper_id", "created_at")


def activity_of_uploads(files: DataFrame) -> DataFrame:
    """Activity rows of uploaded files(paper_id, file_name, created_at)."""
    return files.select(F.lit("upload").alias("event_type"), F.concat(F.lit("Uploaded "), "file_name").alias("description"), "paper_id", "created_at")


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Add the rows of a numbered batch to a log table; a batch that is run again replaces itself.

    The log has a column `batch`. To commit logs together with tables use `store.Store`.
    """
    rows.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def update_by_key(
    target: DataFrame, changes: DataFrame, key: str = "paper_id", limits: Mapping[str, int] | None = None, newest: Column | None = None
) -> DataFrame:
    """Overwrite columns of matching rows; a target row stays one row however many changes it gets.

    A column `changed` (array of names) says which columns a change sets, null included; without it a
    change sets its columns that are not null. Several changes of one key apply by ascending `newest`,
    column by column; without it, and among equals, the larger value is the later one.
    """
    limits = limits or {}
    fields = [c for c in changes.columns if c not in (key, "changed")]
    sets = lambda c: F.array_contains("changed", c) if "changed" in changes.columns else F.col(c).isNotNull()
    value = lambda c: F.left(c, F.lit(limits[c])) if c in limits else F.col(c)
    at = lambda c: F.struct((F.lit(0) if newest is None else newest).alias("at"), F.col(c).alias("by"))
    # A change is a struct around the value, so that setting null differs from not setting.
    new = changes.groupBy(key).agg(*[F.max_by(F.struct(value(c).alias("v")), F.when(sets(c), at(c))).alias(f"_new_{c}") for c in fields])
    joined = target.join(new, key, "left")
    fresh = lambda c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(F.col(c)).alias(c)
    return joined.select(*[fresh(c) if c in fields else F.col(c) for c in target.columns])


def _dealt(df: DataFrame, keys: Sequence[str], n_parts: int | None) -> DataFrame:
    return df if n_parts is None else df.repartition(n_parts, *keys)


def apply_index_outcome(papers: DataFrame, outcomes: DataFrame, n_parts: int | None = None) -> DataFrame:
    """outcomes(paper_id, ok, error, title, page_count, chunk_count[, authors, abstract]): completed with the
    new facts, or failed with the error. Of several outcomes of a paper a failure counts, else the largest row."""
    facts = [c for c in ("page_count", "chunk_count", "authors", "abstract") if c in outcomes.columns and c in papers.columns]
    one = latest(outcomes, ["paper_id"], [F.asc("ok"), F.desc(F.struct(*[c for c in outcomes.columns if c not in ("paper_id", "ok")]))])
    o = one.select("paper_id", *[F.col(c).alias(f"_{c}") for c in ("ok", "error", "title", *facts)])
    joined = _dealt(papers, ["paper_id"], n_parts).join(o, "paper_id", "left")
    fresh = {c: F.when(F.col("_ok"), F.col(f"_{c}")).otherwise(F.col(c)) for c in facts}
    fresh["title"] = F.when(F.col("_ok"), F.left("_title", F.lit(MAX_TITLE))).otherwise(F.col("title"))
    fresh["status"] = F.when(F.col("_ok"), "completed").when(~F.col("_ok"), "failed").otherwise(F.col("status"))
    fresh["error_message"] = F.when(F.col("_ok"), None).when(~F.col("_ok"), F.left("_error", F.lit(MAX_ERROR))).otherwise(F.col("error_message"))
    return joined.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in papers.columns])


def start_indexing(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark papers as being indexed and clear their error."""
    marked = papers.join(ids.select("paper_id").distinct().withColumn("_go", F.lit(True)), "paper_id", "left")
    fresh = {
        "status": F.when(F.col("_go"), "indexing").otherwise(F.col("status")),
        "error_message": F.when(F.col("_go"), None).otherwise(F.col("error_message")),
    }
    return marked.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in papers.columns])


def drop_stale_audits(audits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A new index run invalidates the paper's audit. Summaries are left as they are."""
    return audits.join(outcomes.filter("ok").select("paper_id").distinct(), "paper_id", "left_anti")


def stats(papers: DataFrame, qa_logs: DataFrame, activity: DataFrame) -> DataFrame:
    """One row of counters; each table is read once, and the one-row results are put side by side."""
    one = F.lit(1).alias("_one")
    p = papers.agg(F.count("*").alias("total_papers")).select("*", one)
    q = qa_logs.agg(F.count("*").alias("questions_asked")).select("*", one)
    a = activity.agg(
        F.count_if(F.col("event_type") == "summary").alias("summaries_generated"),
        F.count_if(F.col("event_type").isin(*STUDY_EVENTS)).alias("study_sessions"),
    ).select("*", one)
    return p.join(q, "_one").join(a, "_one").drop("_one")


def recent(df: DataFrame, n: int, by: str = "id") -> DataFrame:
    """Newest rows: a top-n, never a full sort."""
    return df.orderBy(F.desc(by)).limit(n)


def list_papers(papers: DataFrame, sort: str = "recent") -> DataFrame:
    order = {"recent": [F.desc("uploaded_at"), F.col("paper_id")], "title": [F.lower("title"), F.col("title"), F.col("paper_id")]}
    return papers.orderBy(*order[sort])


def search_library(papers: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Papers whose card text contains the term in any case."""
    card = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return papers.filter(F.contains(card, F.lit(term.lower())))


def get(df: DataFrame, **key) -> DataFrame:
    """Rows by key; the filter reaches the Parquet reader."""
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    return df


def paper_tables(tables: DataFrame, paper_id) -> DataFrame:
    return get(tables, paper_id=paper_id).orderBy("table_index").select("table_index", "page", "caption", "markdown", "headers", "rows")


def check_ready(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """requests(request_id, paper_ids): the first paper that is unknown or not completed gives status and reason.

    A request without papers is ready.
    """
    asked = requests.select("request_id", F.posexplode_outer("paper_ids").alias("_pos", "paper_id"))
    joined = asked.join(papers.select("paper_id", "title", "status").withColumn("_known", F.lit(True)), "paper_id", "left")
    code = F.when(F.col("paper_id").isNull(), None).when(F.col("_known").isNull(), 404).when(F.col("status") != "completed", 409)
    reason = F.when(code == 404, F.concat(F.lit("Paper "), F.col("paper_id").cast("string"), F.lit(" not found."))).when(
        code == 409, F.concat(F.lit("'"), "title", F.lit("' is still "), "status", F.lit("."))
    )
    problem = F.when(code.isNotNull(), F.struct("_pos", code.cast("bigint").alias("code"), reason.alias("reason")))
    return joined.groupBy("request_id").agg(F.min(problem).alias("_p")).select(
        "request_id", F.col("_p").isNull().alias("ready"), F.col("_p.code").alias("code"), F.col("_p.reason").alias("reason")
    )


def cache_split(requests: DataFrame, cache: DataFrame, keys: Sequence[str], n_parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests answered from the cache, requests to compute). A true `refresh` column forces computing."""
    keys = list(keys)
    may_hit = ~F.coalesce(F.col("refresh"), F.lit(False)) if "refresh" in requests.columns else F.lit(True)
    known = _dealt(cache.select(*keys), keys, n_parts).distinct().withColumn("_cached", F.lit(True))
    marked = _dealt(requests, keys, n_parts).join(known, keys, "left").withColumn("_hit", F.coalesce(F.col("_cached"), F.lit(False)) & may_hit).drop("_cached")
    return marked.filter("_hit").drop("_hit"), marked.filter("NOT _hit").drop("_hit")


def qa_metrics(qa: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over the stored score and latency of answers."""
    return qa.groupBy(*by).agg(
        F.count("*").alias("n_answers"),
        F.round(F.avg("retrieval_score"), 6).alias("mean_score"),
        F.round(F.avg("latency_sec"), 6).alias("mean_latency"),
        F.max("latency_sec").alias("max_latency"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add `reject_reason` (null when valid) to requests(kind, text, difficulty, n, paper_ids, style, quiz_type)."""
    kind, papers = F.col("kind"), F.coalesce(F.size("paper_ids"), F.lit(0))
    needs_paper = kind.isin("quiz", "flashcards", "gaps", "summary")
    reason = (
        F.when((kind == "qa") & ~F.coalesce(F.length("text"), F.lit(0)).between(1, MAX_QUESTION), "question length")
        .when(needs_paper & (papers < 1), "no paper")
        .when((kind == "compare") & (papers < 2), "Select at least two papers to compare.")
        .when((kind == "quiz") & ~F.coalesce(F.col("quiz_type").isin(*QUIZ_TYPES), F.lit(False)), "unknown quiz type")
        .when((kind == "quiz") & ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "difficulty")
        .when((kind == "quiz") & ~F.coalesce(F.col("n").between(1, MAX_QUIZ), F.lit(False)), "number of questions")
        .when((kind == "flashcards") & ~F.coalesce(F.col("n").between(1, MAX_CARDS), F.lit(False)), "number of cards")
        .when((kind == "summary") & ~F.coalesce(F.col("style").isin(*STYLES), F.lit(False)), "unknown summary type")
    )
    return requests.withColumn("reject_reason", reason)
