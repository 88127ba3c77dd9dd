"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is the log likelihood ratio of a few binned surface features, learnt from the
labelled documents. Hosts and paths under a host get posteriors from the documents they hold; those with
few documents shrink towards the level above, by a strength estimated from the spread of that level. The
score joins the document's evidence with the posterior of its path as its prior.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import written

BINS = 16  # a feature's values, so that all learnt counts fit BINS rows per feature
SMOOTHING = 1.0  # documents of each class added to every bin
TEMPER = 0.5  # features overlap, so their evidence counts half
THRESHOLD = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0


def _level(share: Column, steps: tuple[float, ...]) -> Column:
    """Number of steps a share has reached."""
    return reduce(lambda a, b: a + b, [(share >= s).cast("int") for s in steps])


def features(text: Column) -> dict[str, Column]:
    """Binned surface features of a text; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    chars = F.greatest(F.length(text), F.lit(1))
    per_word = F.greatest(words, F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    fine = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
    return {
        "size": F.least(F.floor(F.log2(words + 1)).cast("int"), F.lit(BINS - 1)),
        "symbols": _level(count(r"[#*$%&|<>@^~={}\[\]\\]") / chars, fine),
        "capitals": _level(count(r"\p{Lu}") / chars, fine),
        "digits": _level(count(r"\p{Nd}") / chars, fine),
        "shouts": _level(count(r"[!?]") / chars, fine),
        "echoes": _level(count(r"(?<!\S)(\S++)(?=\s++\1(?!\S))") / per_word, fine),
        "word_size": F.least(F.floor(chars / per_word).cast("int"), F.lit(BINS - 1)),
        "same_lines": _level(F.lit(1.0) - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)), fine),
        "short_words": _level(count(r"(?<!\S)\p{L}{1,3}[.,]?(?!\S)") / per_word, (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    }


def _evidence(slim: DataFrame, labels: DataFrame, names: list[str]) -> Column:
    """Log likelihood ratio of good against bad by the bins, as one expression with learnt numbers.

    Counts are grouped over all labelled documents; what reaches the driver is at most BINS rows per
    feature and the two class totals.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = slim.join(marks, "doc_id")
    each = known.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("x"))
    counts = each.groupBy("x.f", "x.b").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).limit(BINS * len(names) + 1).collect()
    if len(counts) > BINS * len(names):
        raise ValueError(f"a feature has more than {BINS} bins")
    good = sum(r["good"] for r in counts if r["f"] == names[0])
    bad = sum(r["bad"] for r in counts if r["f"] == names[0])
    total = F.lit(0.0)
    for name in names:
        table_of = {}
        for r in counts:
            if r["f"] == name:
                up = (r["good"] + SMOOTHING) / (good + SMOOTHING * BINS)
                down = (r["bad"] + SMOOTHING) / (bad + SMOOTHING * BINS)
                table_of[r["b"]] = (up, down)
        case = reduce(
            lambda e, kv: e.when(F.col(name) == kv[0], F.log(F.lit(kv[1][0])) - F.log(F.lit(kv[1][1]))),
            sorted(table_of.items()),
            F.when(F.lit(False), F.lit(0.0)),
        ).otherwise(F.lit(0.0))
        total = total + case
    return total * TEMPER


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p) - F.log(1 - p)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _strength(groups: DataFrame, n: str, total: str, above: str) -> DataFrame:
    """One row: documents' worth of the level above, by the method of moments over the groups."""
    gap = F.col(total) / F.col(n) - F.col(above)
    within = F.col(above) * (1 - F.col(above))
    sums = groups.groupBy((F.col(n) > 0).alias("some")).agg(
        F.sum(F.col(n) * gap * gap).alias("spread"), F.sum(within).alias("noise"), F.sum(F.col(n) * within).alias("within"), F.sum(n).alias("all_n")
    )
    between = F.greatest((F.col("spread") - F.col("noise")) / F.col("all_n"), F.lit(1e-9))
    strength = F.col("within") / F.col("all_n") / between - 1
    return sums.select("some", F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength"))


def _named(group: Column) -> Column:
    """Name of a group that joins can use: null has a name that no text has."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, kept, doc_evidence, host_posterior, path_posterior), one row per input row.

    Null hosts and paths are groups of their own, apart from empty ones. Null and empty texts count as empty,
    very long ones are read whole, equal texts of one path have equal scores, and a score at the threshold is
    kept. A null doc_id has no label. An empty table gives no rows; other columns are ignored. Labels that are null or
    belong to no document are ignored, several for one document are averaged, and without any label
    every score is 0.5. Features are written to the shared folder once; later passes read only them.
    """
    feats = features(F.col("text"))
    names = list(feats)
    slim = written(
        docs.select("doc_id", _named(host).alias("host"), _named(path).alias("path"), *[c.alias(n) for n, c in feats.items()]),
        "features",
    )
    told = slim.select("doc_id", "host", "path", _evidence(slim, labels, names).alias("doc_evidence")).withColumn("p", _sigmoid(F.col("doc_evidence")))
    paths = told.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")).withColumn("some", F.col("host_n") > 0)
    whole = hosts.groupBy("some").agg((F.sum("host_good") / F.sum("host_n")).alias("prior"))
    hosts = hosts.join(whole, "some")
    hosts = hosts.join(_strength(hosts, "host_n", "host_good", "prior"), "some").select(
        "host", ((F.col("host_good") + F.col("strength") * F.col("prior")) / (F.col("host_n") + F.col("strength"))).alias("host_posterior")
    )
    under = paths.join(hosts, "host").withColumn("some", F.col("n") > 0)
    under = under.join(_strength(under, "n", "good", "host_posterior"), "some").select(
        "host",
        "path",
        "host_posterior",
        ((F.col("good") + F.col("strength") * F.col("host_posterior")) / (F.col("n") + F.col("strength"))).alias("path_posterior"),
    )
    score = _sigmoid(F.col("doc_evidence") + _logit(F.col("path_posterior")))
    return told.join(under, ["host", "path"]).select(
        "doc_id", score.alias("score"), (score >= threshold).alias("kept"), "doc_evidence", "host_posterior", "path_posterior"
    )


@query("op6_quality_bayes")
def op6_quality_bayes(spark: SparkSession, folder: str) -> DataFrame:
    """Sources are the hosts; a language under a source is a path."""
    docs = table(spark, folder, "documents")
    return classify(docs, table(spark, folder, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
