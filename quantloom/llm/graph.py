"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Stage


TASK_EDGES = 50_000  # a written table has a task for so many edges, where their number is known


def components(links: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) that isn't itself the root, the least of its component.

    Each round hangs the neighbours of a node on the least of them, first the larger
    neighbours, then the smaller; the edge list shrinks to stars in a number of rounds
    that grows with the logarithm of the component size.  The rounds end when no node
    has two smaller neighbours, or smaller and larger ones: those are stars on the least.  Every
    round is a written table.  An empty list gives an empty result; loops and repeated edges don't matter.
    """
    edges = stage.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step = 0
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, open_ = ends.agg(F.sum("up"), F.max(F.col("up") + F.col("down") > 1)).first()
        if not open_:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step, tasks = step + 1, 1 + n // TASK_EDGES
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stage.write(large.coalesce(tasks), f"{name}-{step}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage.write(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), f"{name}-{step}")
        stage.drop(f"{name}-{step - 1}", f"{name}-{step}a")
