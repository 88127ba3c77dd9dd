"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w among sources holding n of N documents repeats each document w * N / n times on
average. A document's own number of copies is a Poisson number with that mean, found by inverting the
distribution at a uniform number hashed from the document; copies are dealt out by another hash, so
the output is one global shuffle that repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table

SEED = "mix-1"
POWER = 0.7  # default weights are document counts to this power, which lifts small sources
STEP = 500.0  # larger means are sums of Poisson numbers with means up to this, where exp() is exact enough
MANY_SOURCES = 10_000  # a table of rates up to this size is broadcast


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson(rate: Column, *parts: Column) -> Column:
    """Poisson number with mean `rate` (0 for null, NaN or negative), the same for equal parts.

    The smallest k whose cumulated probability exceeds the hashed uniform number. Probabilities are
    added from 0 to rate + 12 sqrt(rate) + 30, beyond which less than one part in 2**52 remains.
    """
    rate = F.when((rate > 0) & ~F.isnan(rate), rate).otherwise(F.lit(0.0))
    shares = F.ceil(rate / STEP).cast("int")

    def one(nth: Column) -> Column:
        mean = rate / shares
        last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
        u = uniform(*parts, nth.cast("string"))
        start = F.struct(u.alias("u"), mean.alias("m"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * s["m"] / k
            return F.when(s["c"] > s["u"], s).otherwise(
                F.struct(s["u"].alias("u"), s["m"].alias("m"), p.alias("p"), (s["c"] + p).alias("c"), k.alias("k"))
            )

        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])

    many = F.aggregate(F.transform(F.sequence(F.lit(1), shares), one), F.lit(0), lambda a, b: a + b)
    return F.when(shares < 1, F.lit(0)).otherwise(many)


def source_rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = POWER) -> DataFrame:
    """(source, n, rate): mean copies of a document of each source; null is a source of its own.

    `weights` is a table (source, weight); a source without one gets 0 and so no copies, and weights
    are scaled to sum to 1 over the sources that hold documents. Without a table, the weight is the
    source's number of documents to the given power. `epochs` is the size of the output over the input.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("w"))
        weighted = counts.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighted = weighted.withColumn("held", F.col("n") > 0)
    totals = weighted.groupBy("held").agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    rate = F.when(F.col("all_w") > 0, F.lit(epochs) * F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0)
    return weighted.join(totals, "held").select("source", "n", rate.alias("rate"))


def document_name(text: Column) -> Column:
    """What a document is hashed by: its doc_id, or without one its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = POWER, seed: str = SEED) -> DataFrame:
    """All columns of `docs`, `copy_no` (from 1) and `shuffle_key`, in globally shuffled order.

    Documents whose number is 0 are left out: that is the sampling asked for. Rows with a null doc_id go by
    their text instead; rows of one doc_id, and rows without one that have the same text, get the same number
    of copies each. Rows are dealt by key and text, so only rows equal in both share a place for certain.
    Input columns named like the added ones give way to them.
    """
    rates = source_rates(docs, weights, epochs, power)
    if rates.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES:
        rates = F.broadcast(rates)  # else a hot source is split by the join
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    text = F.col("text").cast("string") if "text" in names else F.lit(None).cast("string")
    # The row travels as one column, so no name of the input can clash with those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("from"), document_name(text).alias("doc"), F.xxhash64(text).alias("deal"))
    rated = rows.join(rates, F.col("from").eqNullSafe(F.col("source")))
    counted = rated.select("row", "doc", "deal", poisson(F.col("rate"), F.lit(seed), F.col("doc")).alias("copies")).where("copies > 0")
    copies = counted.select("row", "doc", "deal", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("doc"), F.col("copy_no").cast("string")))
    dealt = copies.select("row", "copy_no", key.alias("key"), "deal").repartition("key", "deal").sortWithinPartitions("key")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in names], "copy_no", F.col("key").alias("shuffle_key"))


_NAME = "coalesce(d.doc_id::VARCHAR, 'text ' || md5(coalesce(d.text, '')))"
_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {POWER}) AS w FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * w / (SELECT sum(w) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS m FROM counts),
drawn AS (SELECT DISTINCT {_NAME} AS doc, r.source, r.m, ('0x' || substr(md5('{SEED}|' || doc || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (SELECT doc, source, m, u, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM drawn
  UNION ALL SELECT doc, source, m, u, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM steps WHERE NOT c > u AND k < ceil(m + 12 * sqrt(m) + 30)),
numbers AS (SELECT doc, source, max(k) AS k FROM steps GROUP BY doc, source)
SELECT d.*, i.copy_no::INTEGER AS copy_no, md5('{SEED}|order|' || n.doc || '|' || i.copy_no) AS shuffle_key
FROM documents d JOIN numbers n ON n.doc = {_NAME} AND d.source IS NOT DISTINCT FROM n.source, unnest(range(1, k + 1)) AS i(copy_no)
"""


@query("op4_mixing", _SQL)
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))
