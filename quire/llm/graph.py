"""Connected components of a table of links, in a number of rounds that grows with the logarithm of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import files_for, written

ROWS = 200_000  # links or nodes of a file


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (a, b): root is the smallest node of its component.

    Each round lets every node point to its smallest neighbour, follows pointers to their ends, and
    contracts the links to the ends; nothing but counts reaches the driver. Null ends are ignored.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    files, labels = files_for(2 * links.count(), ROWS), None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "pointers", files)
        while True:
            ends = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            further = written(up.join(ends, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "pointers", files)
            moved = further.where("moved").limit(1).count()
            up = further.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        to_a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = written(links.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links", files)
        if not links.limit(1).count():
            return written(labels, "labels", files)
