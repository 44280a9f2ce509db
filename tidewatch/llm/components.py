"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of `links` (a, b) can reach.

    Stars are made around ever smaller nodes until nothing changes: each round
    ties all larger neighbours of a node to its smallest neighbour, then all
    smaller ones. The number of rounds grows with the logarithm of the longest
    path; each round is written, so none is computed twice. Links with a null end
    and loops are left out; nodes without other links do not appear.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = cut_lineage(ordered), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        tied = large.join(lowest, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut_lineage(tied.unionAll(lowest.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
