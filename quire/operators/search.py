"""Exact cosine top-k, routing, hit shaping, citations.

Scoring runs inside the tasks that read the vectors. The queries are a table of bounded files in the
shared folder; a task holds a slice of vectors, reads the files one after another, and lets only the best
k rows per query leave. No pair of a query and a chunk ever becomes a row, no query passes through the
driver, and the vectors are read once whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from quire.operators.scan import first_rows
from quire.session import new_folder

TOP_K = 5
TOP_K_TABLES = 2
TABLE_MODE_K = (3, 4)  # text, tables
MAX_TABLE_CHARS = 6000
QUERY_BLOCK = 8192  # queries of a file: 64 MB of 1024-dimensional doubles
SLICE_BYTES = 64 << 20  # vectors a task holds while it reads the queries
_SLICE = 256
DECIMALS = 9
_SLACK = 2e-9

# Words that send a question to the tables as well.
TABULAR_WORDS = (
    "table", "result", "accuracy", "f1", "bleu", "rouge", "latency", "benchmark", "ablation", "comparison",
    "compare", "performance", "%", "baseline", "score", "metric", "hyperparameter", "learning rate",
    "batch size", "dataset size", "how many", "how much", "number of", "precision", "recall", "auc",
    "perplexity", "error rate", "outperform", "sota", "state of the art", "speed", "throughput",
)


def paper_filter(df: DataFrame, papers: Sequence | DataFrame | None, column: str = "paper_id") -> DataFrame:
    """Rows of some papers. None or an empty list means the whole corpus."""
    if papers is None:
        return df
    if isinstance(papers, DataFrame):
        return df.join(papers.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(papers))) if len(papers) else df


def _stored(queries: DataFrame, block: int) -> tuple[int, list[str]]:
    """The number of queries, and files of at most about `block` of them. Rows are dealt out by number, so
    a query_id that is repeated lies in many files."""
    spark = queries.sparkSession
    folder = new_folder(spark, "queries")
    queries.write.parquet(folder)
    held = spark.read.schema(queries.schema).parquet(folder)
    n = held.count()
    if len(held.inputFiles()) > -(-n // block) or n > block:
        folder = f"{folder}-dealt"
        held.repartition(max(1, -(-n // block))).write.option("maxRecordsPerFile", block).parquet(folder)
        held = spark.read.schema(queries.schema).parquet(folder)
    return n, sorted(held.inputFiles()) if n else []


@lru_cache(maxsize=2)
def _queries_of(file: str) -> tuple[pa.Array, np.ndarray, list[set | None]]:
    """Ids, vectors and allowed papers of the queries in a file, as a task reads them."""
    system, path = pa.fs.FileSystem.from_uri(file)
    told = pa.parquet.read_table(path, filesystem=system).combine_chunks()
    rows = told.num_rows
    vectors = told.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False) if rows else np.empty(0)
    if rows and (len(flat) % rows or np.ptp(vectors.value_lengths().to_numpy(zero_copy_only=False))):
        raise ValueError("every query must have the same number of dimensions")
    allowed = [set(p) if p else None for p in told.column("paper_ids").to_pylist()] if "paper_ids" in told.column_names else [None] * rows
    return told.column("query_id").combine_chunks(), flat.reshape(rows, len(flat) // rows if rows else 0), allowed


def _norms(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) if m.size else np.ones(len(m))
    return np.where(n == 0, 1.0, n)


def _places(papers: np.ndarray) -> dict:
    """Rows of each paper of a slice."""
    names, coded = np.unique(papers, return_inverse=True)
    order = np.argsort(coded, kind="stable")
    return dict(zip(names.tolist(), np.split(order, np.cumsum(np.bincount(coded))[:-1]), strict=True))


def _best(
    vectors: np.ndarray, matrix: np.ndarray, ties: list[np.ndarray], groups: np.ndarray | None,
    allowed: list[set | None], papers: np.ndarray | None, k: int, min_score: float | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the best k rows of a batch per query, or per query and group.

    A fast matrix product picks candidates; they are scored again by a left-to-right sum, so that
    equal vectors have equal scores, rounded to nine decimals, and ties always break by the row keys.
    """
    rows, cols, scores = [], [], []
    row_norm, query_norm = _norms(vectors), _norms(matrix)
    places = _places(papers) if any(a is not None for a in allowed) else {}
    open_to_all = [q for q, a in enumerate(allowed) if a is None]
    for first in range(0, len(matrix), _SLICE):
        every = [q for q in open_to_all[first : first + _SLICE]]
        rough = (vectors @ matrix[every].T) / row_norm[:, None] / query_norm[None, every] if every else None
        own = [q for q in range(first, min(first + _SLICE, len(matrix))) if allowed[q] is not None]
        for q, at in [*((q, n) for n, q in enumerate(every)), *((q, None) for q in own)]:
            if at is not None:
                pool, near = np.arange(len(vectors)), rough[:, at]
            else:  # a restricted query meets the rows of its papers and no others
                found = [places[p] for p in allowed[q] if p in places]
                if not found:
                    continue
                pool = np.sort(np.concatenate(found))
                near = np.full(len(vectors), -np.inf)
                near[pool] = vectors[pool] @ matrix[q] / row_norm[pool] / query_norm[q]
            if not len(pool):
                continue
            group = np.zeros(len(pool), int) if groups is None else groups[pool]
            order = np.lexsort((-near[pool], group))
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            sizes = np.diff(np.r_[starts, len(order)])
            last = order[starts + np.minimum(k, sizes) - 1]
            floor = np.empty(group.max() + 1)
            floor[group[last]] = near[pool[last]]
            keep = near[pool] >= floor[group] - _SLACK
            pool, group = pool[keep], group[keep]
            exact = np.round(np.cumsum(vectors[pool] * matrix[q], axis=1)[:, -1] / (row_norm[pool] * query_norm[q]), DECIMALS)
            order = np.lexsort([t[pool] for t in reversed(ties)] + [-exact, group])
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            chosen = order[place < k]
            if min_score:
                chosen = chosen[exact[chosen] >= min_score]
            rows.append(pool[chosen])
            cols.append(np.full(len(chosen), q))
            scores.append(exact[chosen])
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def knn(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    papers: Sequence | DataFrame | None = None,
    min_score: float | None = None,
    per_paper: bool = False,
    keys: Sequence[str] = ("paper_id", "chunk_index"),
    payload: Sequence[str] = (),
    block: int = QUERY_BLOCK,
    openers: int = 0,
) -> DataFrame:
    """Top-k rows of `chunks` by cosine for every row of queries(query_id, embedding[, paper_ids]).

    `papers` restricts all queries, a `paper_ids` array restricts its own query (null or empty: no
    restriction). `per_paper` ranks within each paper. A `min_score` of 0 means no threshold. Ties
    break by `keys`. `payload` columns come along; name few, or join them to the hits later. Chunks
    with an index below `openers` are returned for every query, without rank and score, beside its best
    others; this is for at most `block` queries. They leave with the hits of their slice, so the vectors
    are worked out once.
    Rows without a vector take no part. The queries are written to the shared folder when the plan is made.
    A restricted query is multiplied with the vectors of its papers only.
    """
    keys, payload = list(keys), list(payload)
    # Rows without a vector are left out by the tasks that score: a filter on a vector that is an expression
    # would work it out once for the filter and once more for the row.
    every = paper_filter(chunks, papers)
    source = every.select(*keys, *payload, F.col("embedding").cast("array<double>").alias("embedding"))
    query_type = queries.schema["query_id"].dataType
    id_type = to_arrow_type(query_type)
    own_papers = "paper_ids" in queries.columns
    schema = T.StructType(
        [T.StructField("query_id", query_type)]
        + [T.StructField(c, source.schema[c].dataType) for c in keys + payload]
        + [T.StructField("score", T.DoubleType())]
    )
    wanted = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), *(["paper_ids"] if own_papers else []))

    n_queries, files = _stored(wanted, block)
    if not n_queries:
        return source.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))

    def shrink(held: pa.Table) -> pa.Table:
        """The best k rows of each query of what a task has seen so far."""
        query = held.column("_q").to_numpy()
        ties = [held.column(c).to_numpy() for c in keys]
        order = np.lexsort([*reversed(ties), -held.column("score").to_numpy(), query])
        starts = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return held.take(pa.array(order[place < k]))

    def scored(rows: pa.Table, file: str) -> tuple[pa.Table, np.ndarray]:
        """The best rows of a slice for the queries of a file, and their places in the slice."""
        ids, matrix, allowed = _queries_of(file)
        if not len(ids):
            return pa.Table.from_batches([], to_arrow_schema(schema).append(pa.field("_q", pa.int64()))), np.empty(0, int)
        vectors = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if len(vectors) != rows.num_rows * matrix.shape[1]:
            raise ValueError(f"every vector must have {matrix.shape[1]} dimensions, like the queries")
        ties = [rows.column(c).to_numpy() for c in keys]
        groups = np.unique(ties[0], return_inverse=True)[1] if per_paper else None
        at, query, value = _best(vectors.reshape(rows.num_rows, -1), matrix, ties, groups, allowed, ties[0], k, min_score)
        kept = rows.select([*keys, *payload]).take(pa.array(at))
        made = [ids.cast(id_type).take(pa.array(query)), *kept.columns, pa.array(value), pa.array(query)]
        return pa.Table.from_arrays(made, names=["query_id", *keys, *payload, "score", "_q"]), at

    def opening(rows: pa.Table, file: str, best: pa.Table, at: np.ndarray) -> Iterator[pa.Table]:
        """The openers of a slice that are not among a query's best there, for each query of a file, without a score."""
        first = np.flatnonzero(pc.fill_null(pc.less(rows.column(keys[1]), openers), False).to_numpy())
        ids, query = _queries_of(file)[0].cast(id_type), best.column("_q").to_numpy()
        order = np.argsort(query, kind="stable")
        taken = np.split(at[order], np.searchsorted(query[order], np.arange(1, len(ids)))) if len(ids) else []
        for q, own in enumerate(taken):
            kept = rows.select([*keys, *payload]).take(pa.array(np.setdiff1d(first, own)))
            held = [ids.take(pa.array(np.full(kept.num_rows, q))), *kept.columns, pa.nulls(kept.num_rows, pa.float64())]
            yield pa.Table.from_arrays(held, names=["query_id", *keys, *payload, "score"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            vectors = batch.column("embedding")
            if vectors.null_count:
                batch = batch.filter(vectors.is_valid())
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= SLICE_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(files) > 1 or per_paper or openers:  # results go out slice by slice, and are merged by the shuffle
            for rows in slices(batches):
                for file in files:
                    best, at = scored(rows, file)
                    yield from best.drop_columns(["_q"]).combine_chunks().to_batches()
                    for given in opening(rows, file, best, at) if openers else ():
                        yield from given.combine_chunks().to_batches()
            return
        held = None
        for rows in slices(batches):
            part, _ = scored(rows, files[0])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows > 4 * k * n_queries + 1024:
                held = shrink(held)
        if held is not None and held.num_rows:
            yield from shrink(held).drop_columns(["_q"]).combine_chunks().to_batches()

    hits = source.mapInArrow(score, schema)
    group = ["query_id", keys[0]] if per_paper else ["query_id"]
    order = [F.desc("score"), *[F.col(c) for c in keys]]
    if not openers:
        return first_rows(hits, group, order, k)
    if n_queries > block:
        raise ValueError(f"openers are for at most {block} queries")
    # Openers without a score come after all hits of their group, and take nobody's rank; where a query ranks all
    # papers together they form groups of their own, by paper.
    apart = [] if per_paper else [F.when(F.col("score").isNull(), F.col(keys[0]))]
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*group, *apart).orderBy(*order)))
    others = F.col(keys[1]) >= openers
    best = ranked.filter((others & (F.col("rank") <= k)) | (F.col(keys[1]) < openers))
    return best.withColumns({c: F.when(others, F.col(c)) for c in ("score", "rank")})


def attach(hits: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Payload columns for hits, read without the vectors."""
    return hits.join(rows.select(*keys, *columns), list(keys))


def needs_tables(question: Column) -> Column:
    """Does the question ask for numbers: a table word at a word start, or any digit."""
    words = [rf"\b{w}" if w[0].isalnum() else w for w in TABULAR_WORDS]
    return F.lower(question).rlike("(?U)" + "|".join([*words, r"\d"]))


def table_hit_to_chunk(hits: DataFrame, limit: int = MAX_TABLE_CHARS) -> DataFrame:
    """Table hits in the shape of text hits: long Markdown is cut at a line end, indexes are negative."""
    head = F.left("markdown", F.lit(limit))
    whole_lines = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    text = F.when(F.length("markdown") > limit, F.concat(whole_lines, F.lit("\n| ... |"))).otherwise(F.col("markdown"))
    return hits.withColumns(
        {
            "kind": F.lit("table"),
            "section": F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.concat(F.lit("Table "), F.col("table_index").cast("string"))),
            "chunk_index": -F.col("table_index").cast("bigint"),
            "text": text,
        }
    ).drop("caption", "markdown")


def retrieve_multimodal(
    questions: DataFrame, chunks: DataFrame, tables: DataFrame,
    k_text: int = TOP_K, k_tables: int = TOP_K_TABLES, force: bool = False,
    papers: Sequence | DataFrame | None = None, min_score: float | None = None,
    text_payload: Sequence[str] = ("paper_name", "page", "section", "text"),
    table_payload: Sequence[str] = ("paper_name", "page", "caption", "markdown"),
) -> DataFrame:
    """Text hits for all questions, table hits for those that need them, in one shape with `kind`.

    questions(query_id, text, embedding): the vector is computed once and serves both searches.
    """
    text = knn(chunks, questions, k_text, papers, min_score, payload=text_payload).withColumns(
        {"kind": F.lit("text"), "table_index": F.lit(None).cast("bigint")}
    )
    if k_tables <= 0:
        return text
    routed = questions if force else questions.filter(needs_tables(F.col("text")))
    found = knn(tables, routed, k_tables, papers, min_score, keys=("paper_id", "table_index"), payload=table_payload)
    return text.unionByName(table_hit_to_chunk(found.withColumn("table_index", F.col("table_index").cast("bigint"))), allowMissingColumns=True)


def order_hits(hits: DataFrame, table_mode: bool = False) -> DataFrame:
    """One list per question: text before tables, or tables before text in table mode."""
    first = F.col("kind") == F.lit("table" if table_mode else "text")
    order = [F.when(first, 0).otherwise(1), F.col("rank"), F.col("paper_id"), F.col("chunk_index")]
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def retrieve(questions: DataFrame, chunks: DataFrame, tables: DataFrame, table_mode: bool = False, **options) -> DataFrame:
    """The hit list an answer is built from."""
    if table_mode:
        k_text, k_tables = TABLE_MODE_K
        options = {"k_text": k_text, "k_tables": k_tables, "force": True, **options}
    return order_hits(retrieve_multimodal(questions, chunks, tables, **options), table_mode)


def _mean_score(mean: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 3)


def retrieval_score(used: DataFrame) -> DataFrame:
    """Mean score of the hits used for each question, within 0 and 1."""
    return used.groupBy("query_id").agg(_mean_score(F.avg("score")).alias("retrieval_score"))


def with_retrieval_score(used: DataFrame) -> DataFrame:
    """The same, on every used hit; the few hits of a question are already together."""
    return used.withColumn("retrieval_score", _mean_score(F.avg("score").over(Window.partitionBy("query_id"))))


def to_citation(hits: DataFrame, *extra: str) -> DataFrame:
    """Citation fields of hits, and any `extra` columns as they are."""
    have = set(hits.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    built = F.concat(F.col("paper_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string"))
    return hits.select(
        "query_id", *([c for c in ("position", "rank") if c in have]),
        "paper_id", "paper_name", "page", "section",
        col("id", built).alias("chunk_id"),
        F.col("text").alias("text_snippet"),
        F.round(col("score", F.lit(0.0)), 4).alias("score"),
        col("kind", F.lit("text")).alias("kind"),
        col("table_index", F.lit(None).cast("bigint")).alias("table_index"),
        *extra,
    )


def paper_chunks(chunks: DataFrame, papers: Sequence | DataFrame | None) -> DataFrame:
    """Chunks of papers in reading order. Vectors are not read."""
    return paper_filter(chunks.drop("embedding"), papers).orderBy("paper_id", "chunk_index")


def collection_info(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count("*").alias("points_count"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("bigint").alias("vector_size"),
    ).withColumn("distance", F.lit("Cosine"))
