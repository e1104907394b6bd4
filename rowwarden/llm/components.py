"""Connected components by alternating stars, on tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in edges (a, b: bigint).

    Large and small stars alternate: each node's larger neighbours, then its smaller ones, are tied to the smallest
    node it sees, until all ties go to the smallest node of a component. The minimum of a node's neighbours is
    pre-aggregated, and only joined back by key, so a node with very many neighbours is never in one task's memory.
    """
    ties = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "ties")
    before = None
    while True:
        both = ties.union(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).select(F.col("a").alias("node"), "low")
        large = both.where("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.union(low.where("low < node").select("node", "low")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
        small = large.join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low).distinct()
        ties = written(small, "ties")
        state = ties.agg(F.count("*").alias("n"), F.sum("b").alias("s"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_if(F.col("a") <= F.col("b")).alias("x")).collect()[0]
        if state == before:
            break
        before = state
    low = ties.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return low.union(ties.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
