"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the same for all nodes of a component, and one of them.

    Each round hooks every node to its least neighbour and contracts the edges. Node numbers are hashes, so a fixed share of the
    nodes goes in each round and the number of rounds grows with the logarithm of the largest component. A hub's edges
    are reduced before the shuffle. Every round is a table in the shared folder.
    """
    pairs = common.written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        parents = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "parents")
        rounds.append(parents)
        hop = pairs.join(parents.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a").join(parents.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b")
        last = pairs
        pairs = common.written(hop.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        common.discard(last)
    common.discard(pairs)
    if not rounds:
        return common.written(edges.sparkSession.createDataFrame([], "node long, root long"), "components")
    found = rounds[-1]
    for parents in rounds[-2::-1]:
        above = found.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        found = parents.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    out = common.written(found, "components")
    common.discard(*rounds)
    return out
