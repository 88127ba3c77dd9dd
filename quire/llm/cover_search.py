"""Exact top-k inner products by dual-tree search on cover trees.

Vectors are dealt to cells around centres from a bounded sample, and cells to blocks of bounded size. Queries
first search a block of their own cell, which gives each a kth score to beat. Groups of queries then meet
only the blocks whose bound, from both covering radii, reaches the worst kth score of the group; there a
cover tree over the queries and one over the block are descended together, pruning in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.registry import query, table

K = 5
SAMPLE = 4096  # vectors from which centres are chosen, the only rows that reach the driver
CENTRES = 48
BLOCK = 8192  # vectors of a block, about
GROUP = 512  # queries of a group, about
FANOUT = 32  # children of a tree node at most
LEAF = 64
NEAR = 256  # blocks a bucket of block summaries holds, about
LOWEST = -(2**63)  # stands for a kth score that is not known yet; scores are held within long


def scaled(vector: Column) -> Column:
    """floor(256 x) of every component, or null if the vector or a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("bigint")))


def centres(sample: np.ndarray, limit: int) -> np.ndarray:
    """Rows picked farthest first, from the one nearest to the mean; fewer than `limit` if rows repeat."""
    if not len(sample):
        return sample
    far = np.linalg.norm(sample - sample.mean(axis=0), axis=1)
    picked = [int(np.argmin(far))]
    near = np.linalg.norm(sample - sample[picked[0]], axis=1)
    while len(picked) < min(limit, len(sample)) and near.max() > 0:
        picked.append(int(np.argmax(near)))
        near = np.minimum(near, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


class Tree:
    """Cover tree over the rows of a matrix: a node's centre is a row, its children are centres picked
    farthest first with the rows nearest to them, its radius is the distance of its farthest row. The tree
    is built in doubles; `whole` keeps the integers that scores are made of."""

    def __init__(self, whole: np.ndarray) -> None:
        self.whole = whole
        rows = whole.astype(np.float64)
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        at, radius = [], []
        todo: list[tuple[np.ndarray, int]] = [(np.arange(len(rows)), -1)]
        while todo:
            own, parent = todo.pop()
            points = rows[own]
            middle = points[int(np.argmin(np.linalg.norm(points - points.mean(axis=0), axis=1)))]
            away = np.linalg.norm(points - middle, axis=1)
            node = len(at)
            at.append(middle)
            radius.append(away.max())
            self.members.append(own)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if len(own) > LEAF and away.max() > 0:
                picked = centres(points, FANOUT)
                squares = (points**2).sum(axis=1)[:, None] - 2 * points @ picked.T + (picked**2).sum(axis=1)
                nearest = np.argmin(squares, axis=1)
                parts = [own[nearest == c] for c in range(len(picked))]
                if sum(len(p) > 0 for p in parts) > 1:
                    todo.extend((p, node) for p in parts if len(p))
        self.centre, self.radius = np.array(at), np.array(radius) * (1 + 1e-9) + 1e-9
        self.norm = np.linalg.norm(self.centre, axis=1)


def bound(middle_a, radius_a, norm_a, middle_b, radius_b, norm_b):  # noqa: ANN001, ANN201
    """Largest inner product of a row of one node with a row of another, rounding allowed for."""
    most = middle_b @ middle_a + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    return most + 1e-9 * (np.abs(most) + norm_a * norm_b + 1)


class Best:
    """The k best scores of each query, ties to smaller numbers; short lists are filled with nothing."""

    def __init__(self, ids: np.ndarray, worst: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.floor = worst.astype(np.int64)  # a score known to be reached, or LOWEST
        self.scores = [np.empty(0, np.int64)] * len(ids)
        self.found = [np.empty(0, np.int64)] * len(ids)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer candidates `ids` with scores (queries x candidates) to the queries at `at`."""
        take = (scores >= self.floor[at][:, None]) & (ids[None, :] != self.ids[at][:, None])
        for row in np.flatnonzero(take.any(axis=1)):
            q, cols = at[row], np.flatnonzero(take[row])
            s = np.concatenate([self.scores[q], scores[row, cols]])
            i = np.concatenate([self.found[q], ids[cols]])
            order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, and has no overflow
            self.scores[q], self.found[q] = s[order], i[order]
            if len(order) == self.k:
                self.floor[q] = max(self.floor[q], s[order[-1]])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond 2**53 in Python integers, held within long."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not a.size or not b.size or np.abs(x).max() * np.abs(y).max() * a.shape[1] < 2.0**53:
        return (x @ y.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    big = exact(a) @ exact(b).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def dual_search(queries: Tree, data: Tree, ids: np.ndarray, best: Best) -> None:
    """Descend both trees together; a data node is dropped for a query node when their bound is below
    the worst kth score of the node's queries."""
    todo = [(0, np.array([0]))]
    while todo:
        node, front = todo.pop()
        own = queries.members[node]
        leaf = not queries.children[node]
        while True:
            most = bound(queries.centre[node], queries.radius[node], queries.norm[node], data.centre[front], data.radius[front], data.norm[front])
            keep = most >= best.floor[own].min()
            front, most = front[keep], most[keep]
            inner = [n for n in front if data.children[n]]
            if not inner:
                break
            front = np.array([c for n in front for c in (data.children[n] or [n])])
            if not leaf:
                break
        if not leaf:
            todo.extend((child, front) for child in queries.children[node])
            continue
        order = np.argsort(-most, kind="stable")
        for n in range(0, len(order), 8):
            near = order[n : n + 8]
            near = near[most[near] >= best.floor[own].min()]
            if not len(near):
                break
            rows = np.concatenate([data.members[x] for x in front[near]])
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                best.add(own, products(queries.whole[own], data.whole[part]), ids[part])


def _meet(rows: DataFrame, k: int) -> DataFrame:
    """Top k of each query in each block. `rows` holds data (kind 0) and queries (kind 1) by block; a
    block's rows are read in order, so a task holds one block and one batch of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, tree, ids = None, [], None, None
        for batch in batches:
            found = []
            for (block, kind), own in batch.groupby(["block", "kind"], sort=True):
                if block != now:
                    now, parts, tree = block, [], None
                if kind == 0:
                    parts.append((own["vec_id"].to_numpy(np.int64), np.array(own["v"].tolist(), np.int64).reshape(len(own), -1)))
                    continue
                if tree is None and parts:
                    ids = np.concatenate([p[0] for p in parts])
                    tree = Tree(np.concatenate([p[1] for p in parts]))
                if not parts:
                    continue
                for at in range(0, len(own), GROUP):
                    part = own.iloc[at : at + GROUP]
                    best = Best(part["vec_id"].to_numpy(np.int64), part["worst"].to_numpy(np.int64), k)
                    dual_search(Tree(np.array(part["v"].tolist(), np.int64).reshape(len(part), -1)), tree, ids, best)
                    for q in range(len(part)):
                        found.append(pd.DataFrame({"query_id": best.ids[q], "vec_id": best.found[q], "score": best.scores[q]}))
            if found:
                yield pd.concat(found, ignore_index=True).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "near")
    return dealt.select("block", "kind", "vec_id", "v", "worst").mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, data: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Both inputs are (vec_id, embedding); components become floor(256 x). Rows with a null vec_id, or a
    vector that is null or holds null or non-finite components, take no part; vectors of unequal length
    have no product. A query's own vec_id is no candidate. Scores are exact at any size, those outside long are
    its ends, and equal scores go to smaller vec_ids. Rows of data that repeat count each; repeated
    queries are asked once. Queries without candidates give no row.
    """
    spark = data.sparkSession
    pick = lambda df: df.select("vec_id", scaled(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    rows, asked = pick(data), pick(queries).dropDuplicates(["vec_id", "v"])
    sample = rows.select("dim", "v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    tops = {d: centres(np.array(v, np.float64).reshape(len(v), d), CENTRES) for d, v in by_dim.items()}

    @F.pandas_udf("cell int, away double")
    def placed(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in vectors:
            cell, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            sizes = batch.map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                top = tops.get(int(dim), np.zeros((1, dim)))
                points = np.array(batch.iloc[at].tolist(), np.float64).reshape(len(at), dim)
                squares = (points**2).sum(axis=1)[:, None] - 2 * points @ top.T + (top**2).sum(axis=1)
                cell[at] = np.argmin(squares, axis=1)
                away[at] = np.linalg.norm(points - top[cell[at]], axis=1)
            yield pd.DataFrame({"cell": cell, "away": away})

    def with_cell(df: DataFrame, size: int) -> DataFrame:
        at = df.withColumn("p", placed("v")).select("vec_id", "v", "dim", F.col("p.cell").alias("cell"), F.col("p.away").alias("away"))
        parts = at.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
        return at.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    block = F.concat_ws("-", "dim", "cell", "part")
    placed_rows = with_cell(rows, BLOCK).withColumn("block", block)
    placed_queries = with_cell(asked, GROUP).withColumn("near", block)
    columns = ["block", "kind", "vec_id", "v", "worst", "near"]
    data_rows = placed_rows.select("block", F.lit(0).alias("kind"), "vec_id", "v", F.lit(LOWEST).cast("bigint").alias("worst"), F.lit("").alias("near"))

    home = placed_queries.select(F.concat_ws("-", "dim", "cell", F.lit(0)).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", F.lit(LOWEST).cast("bigint").alias("worst"), "near")
    first = _ranked(_meet(data_rows.where("block like '%-0'").select(columns).union(home.select(columns)), k), k)
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    asking = placed_queries.join(floors.groupBy("vec_id").agg(F.min("worst").alias("worst")), "vec_id", "left").withColumn("worst", F.coalesce("worst", F.lit(LOWEST)))

    blocks = placed_rows.groupBy("dim", "cell", "block").agg(F.max("away").alias("radius"))
    groups = asking.groupBy("dim", F.col("cell").alias("q_cell"), "near").agg(
        F.max("away").alias("q_radius"), F.min("worst").alias("q_worst")
    )
    buckets = max(1, -(-rows.count() // (BLOCK * NEAR)))
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    groups = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))

    @F.pandas_udf("double")
    def reach(dim: pd.Series, cell: pd.Series, radius: pd.Series, q_cell: pd.Series, q_radius: pd.Series) -> pd.Series:
        out = []
        for d, c, r, qc, qr in zip(dim, cell, radius, q_cell, q_radius, strict=True):
            top = tops.get(int(d), np.zeros((1, d)))
            a, b = top[qc], top[c]
            out.append(float(bound(a, qr + 1e-6, np.linalg.norm(a), b, r + 1e-6, np.linalg.norm(b))))
        return pd.Series(out, dtype="float64")

    pairs = groups.join(blocks, ["dim", "bucket"]).where(reach("dim", "cell", "radius", "q_cell", "q_radius") >= F.col("q_worst")).select("near", "block")
    meeting = asking.join(pairs, "near").select("block", F.lit(1).alias("kind"), "vec_id", "v", "worst", "near")
    found = _meet(data_rows.select(columns).union(meeting.select(columns)), k)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS w FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(w, v)::BIGINT AS score FROM q JOIN v ON vec_id <> query_id AND len(v) = len(w))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""


@query("op2_cover_search", _SQL)
def op2_cover_search(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the vectors whose vec_id is divisible by 50; every other vector is a candidate."""
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)
