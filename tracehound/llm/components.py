"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import shared_folder, total, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge to another: component is the smallest node reachable.

    edges: a, b (long), in any direction and number. Rounds of large stars and small stars: every node hooks its larger
    neighbours, then its smaller ones, to the smallest it knows; the number of rounds grows with the logarithm of the
    graph. Minima combine before the shuffle. Each round is written to the shared folder; the driver sees two numbers of it.
    """
    folder = shared_folder(edges.sparkSession)
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, folder, "edges")
    state, n = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, folder, f"large{n}")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), folder, f"small{n}")
        before, state = state, total(e, F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        n += 1
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
