"""Ordered work per group that stays balanced when one group holds a large share of all rows.

A plain window over a paper puts the whole paper in one task. Here the group is cut into blocks of
consecutive positions, the window runs inside a block, and only one summary row per block takes part
in the window over the whole group. Results are the same as with the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

BLOCK = 4096
BLOCK_COL = "_blk"
CUTS = 4096  # cuts sampled from all groups together, about; at most twice as many and one are broadcast


def _cuts(df: DataFrame, keys: Sequence[str], position: str, block: int) -> DataFrame | None:
    """(keys, _cuts): sorted positions at which the large groups are cut, or None if nothing needs a cut.

    About one row in max(block, rows / CUTS) is picked by a hash of key and position, so the cuts follow
    the rows whatever the numbers are, a group gets cuts by its share of the rows, and the same rows give
    the same cuts again. Only keys and positions are read, and rows are counted only if one in `block`
    is more than the bound.
    """
    slim = df.select(*keys, position)
    pick = lambda each: slim.filter(F.pmod(F.xxhash64(*keys, position), F.lit(each)) == 0).distinct().limit(2 * CUTS + 1).collect()
    picked = pick(block)
    if len(picked) > 2 * CUTS:
        picked = pick(max(block, -(-slim.count() // CUTS)))
    groups: dict[tuple, list] = {}
    for row in picked:
        if row[-1] is not None:
            groups.setdefault(tuple(row[:-1]), []).append(row[-1])
    if not groups:
        return None
    types = [f.dataType for f in slim.schema]
    schema = StructType([*[StructField(f"_k{i}", t) for i, t in enumerate(types[:-1])], StructField("_cuts", ArrayType(types[-1]))])
    return df.sparkSession.createDataFrame([(*key, sorted(cuts)) for key, cuts in groups.items()], schema)


def _in_blocks(df: DataFrame, keys: Sequence[str], position: str, block: int) -> DataFrame:
    cuts = _cuts(df, keys, position, block)
    if cuts is None:
        return df.withColumn(BLOCK_COL, F.lit(0).cast("bigint"))
    same = [df[k].eqNullSafe(cuts[f"_k{i}"]) for i, k in enumerate(keys)]
    passed = F.size(F.filter("_cuts", lambda c: c <= F.col(position)))
    number = F.when(F.col("_cuts").isNull() | F.col(position).isNull(), 0).otherwise(passed).cast("bigint")
    return df.join(F.broadcast(cuts), same, "left").select(*[df[c] for c in df.columns], number.alias(BLOCK_COL))


def carry(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add, for every row, totals and last non-null values of the rows before it in its group.

    `position` is unique within a group; its numbers may be sparse. Groups are cut at sampled positions,
    so blocks hold like numbers of rows and all groups together have about CUTS summaries beyond one
    each, which bounds what the window over a whole group sees. Sampling runs when the plan is made
    and reads the input once more. `sums` and `lasts` map new column -> source column. The result keeps `_blk`, on which
    (with the keys) the rows are partitioned, so that later work on a position needs no shuffle.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    keys = list(keys)
    cut = _in_blocks(df, keys, position, block)
    before = Window.partitionBy(*keys, BLOCK_COL).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select(
        "*",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(f"_in_{o}") for o, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{o}") for o, c in lasts.items()],
    )
    blocks = cut.groupBy(*keys, BLOCK_COL).agg(
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_t_{o}") for o, c in lasts.items()],
    )
    over = Window.partitionBy(*keys).orderBy(BLOCK_COL).rowsBetween(Window.unboundedPreceding, -1)
    above = blocks.select(
        *keys,
        BLOCK_COL,
        *[F.coalesce(F.sum(f"_t_{o}").over(over), F.lit(0)).cast("bigint").alias(f"_b_{o}") for o in sums],
        *[F.last(f"_t_{o}", ignorenulls=True).over(over).alias(f"_b_{o}") for o in lasts],
    )
    joined = inside.join(above, [*keys, BLOCK_COL], "left")
    outs: list[Column] = [(F.col(f"_in_{o}") + F.coalesce(F.col(f"_b_{o}"), F.lit(0))).alias(o) for o in sums]
    outs += [F.coalesce(F.col(f"_in_{o}"), F.col(f"_b_{o}")).alias(o) for o in lasts]
    return joined.select(*df.columns, BLOCK_COL, *outs)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank", slices: int = 1024
) -> DataFrame:
    """The first `limit` rows of every group by `order` (a total order), with their 1-based rank.

    Spark prunes ranks up to 1000 on the map side by itself. Above that the group is first cut into
    slices, by the task that read a row, that are pruned separately, so that no task sorts a whole
    large group, not even one of equal rows. How rows are sliced does not change the result.
    """
    if limit > 1000:
        sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
        part = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = sliced.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= limit).drop("_slice", rank)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by `order`."""
    return first_rows(df, keys, order, 1, "_rank").drop("_rank")
