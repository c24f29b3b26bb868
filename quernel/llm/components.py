"""Connected components of a graph of any size, by alternating large and small stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, written


def components(edges: DataFrame) -> DataFrame:
    """node, component for each node of the edges (u, v: long): component is the smallest node it reaches.

    Each round hangs every node's larger neighbours to the smallest node it knows, then every node and its smaller neighbours to the
    smallest of these; a few rounds leave stars. Rounds end when one changes nothing. Nodes of many neighbours are broadcast, so that no task has all of them.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs, "edges")
    mark = _fingerprint(now)
    while True:
        total = 2 * mark[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = written(join_skewed(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_skewed(large, root, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, mark = mark, _fingerprint(now)
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
