"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.reuse import settled


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds ``name``, each row's position (from 0) in an order.

    Rows are dealt by ranges of the order; a position is the number of rows in the ranges before, from one count
    a range, and the place within its own range.  Equal rows have positions of their own, in no fixed order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def quantile(df: DataFrame, col: str, share: float) -> DataFrame:
    """One row ``cut``: the exact quantile of a column's values, between two neighbours in proportion; null without values."""
    rows = ranked(df.where(F.col(col).isNotNull()).select(col), "_rank", col)
    at = rows.crossJoin(F.broadcast(rows.agg((F.lit(share) * (F.count("*") - 1)).alias("_at"))))  # one row
    near = at.where((F.col("_rank") >= F.floor("_at")) & (F.col("_rank") <= F.ceil("_at")))
    low, high = F.min_by(col, "_rank"), F.max_by(col, "_rank")
    return near.agg((low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("cut"))
