"""Ranks and running totals over whole tables, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources import tables


def running_total(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of the same ``by`` (0 for the first), in ``order``.

    Rows are dealt into ranges of (by, order) and written, so that the dealing is the same for both passes over it. A task adds up its own range; what comes
    before is a total for each range and ``by``, of which there are at most partitions + groups, and that table is broadcast.
    """
    dealt = df.withColumn("_v", value).repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_p", F.spark_partition_id())
    dealt = tables.written(dealt, "ranges")
    sums = dealt.groupBy(*by, "_p").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_i", inside).join(F.broadcast(before), [*by, "_p"]).withColumn(out, F.col("_b") + F.col("_i")).select(*df.columns, out)


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row within ``by``; the order should leave no ties."""
    return running_total(df, by, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) + 1)
