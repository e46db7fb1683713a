"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources import tables


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the component's least node.

    Labels fall to the least label of the neighbours, then jump along their own labels, so the rounds grow with the logarithm of
    the longest path. Each round is a table in the shared folder.
    """
    both = tables.written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct().toDF("node", "near"), "edges")
    labels = tables.written(both.groupBy("node").agg(F.min("near").alias("_m")).select("node", F.least("node", "_m").alias("root")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("near"), F.col("root").alias("_r")), "near").groupBy("node").agg(F.min("_r").alias("_r"))
        low = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "_r").alias("root"))
        jump = low.join(labels.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left").select("node", "old", F.least("root", F.coalesce("_up", "root")).alias("root"))
        new = tables.written(jump, "labels")
        changed = new.filter("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
