"""Connected components by alternating stars, as DataFrame joins over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import store, tasks_for


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Nodes of the links (``a``, ``b``) with the smallest node each can reach: ``node``, ``component``.

    Every round hangs the larger neighbours of a node, then the smaller ones and the node itself, under the smallest of them. Minima are
    taken with partial aggregation and joined back, so a node with very many links is no hot group. Loops, repeated and reversed links
    are harmless; without links the result is empty. A round's tables have as many tasks as its links are worth.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    edges = store(edges.distinct(), tasks=tasks_for(edges.count()))
    mark = None
    while (now := _mark(edges)) != mark and now[0]:
        mark, tasks = now, tasks_for(2 * now[0])
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least")), tasks=tasks)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).filter("a <> b")
        large = store(large.distinct(), tasks=tasks)
        least = store(large.groupBy("a").agg(F.min("b").alias("_least")), tasks=tasks)
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionAll(least.select("a", F.col("_least").alias("b")))
        edges = store(small.filter("a <> b").distinct(), tasks=tasks)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks_for(now[0]))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
