"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.storage import stored, stored_with


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    return stored_with(edges, "edges", n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges (a, b) that isn't its own root.

    Only edges are carried, a round is two written tables, and rounds grow with the logarithm of the
    longest path. The smallest neighbours are a table of their own, so that a node with very many edges
    meets its one row there in a join that Spark can broadcast or split. Loops and repeated edges do no
    harm; rows with a null end are left out; without edges there are no rows.
    """
    e, mark = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while mark["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _kept(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
