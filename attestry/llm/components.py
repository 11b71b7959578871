"""Connected components by alternating large-star and small-star steps (Kiveris and others 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label for every node of edges(a, b): the smallest node that it reaches.

    Loops, repeated and reversed edges do no harm; nodes of loops alone are left out. A hub's edges are never gathered: each step takes a
    minimum by node, which combines before the shuffle, and joins it as a table of its own, so that Spark can split the hub. Every
    step is a written table."""
    now = _canonical(edges)
    state, now = None, common.staged(now, "edges")
    for _ in range(max_rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "least")
        # Large star: what is larger than a node hangs on the smallest of its neighbourhood.
        large = common.staged(_canonical(both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        # Small star: what is smaller than a node, and the node, hang on the smallest.
        low = common.staged(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node"), "low")
        hung = large.join(low, F.col("a") == F.col("node"))
        small = _canonical(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("node").alias("a"), F.col("m").alias("b"))))
        new = common.staged(small, "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        common.drop_staged(now, least, large, low)
        now = new
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    # At the fixed point every edge hangs a node on its label.
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
