"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """u and m, the least of u and its neighbours; a table of its own, so that joins with it can split hot keys."""
    return written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "components-least")


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b; longs) with the smallest node it can reach.

    Each round hangs all larger neighbours of a node on its least neighbour (large star),
    then all smaller ones (small star); about log(n) rounds leave stars. Every round is
    written to the shared folder. Loops, repeated and two-way edges change nothing; nodes
    that only have a loop are left out; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now = written(now, "components-edges")
    mark = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components-large")
        least = _smallest(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "components-edges")
        before, mark = mark, _signature(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
