"""Connected components by alternating large-star and small-star joins; every step is a shuffle with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of one orderable type: (node, root), root the smallest node reachable, for every node of an edge that isn't a root itself.

    A neighbourhood is never gathered: each node learns the least of its neighbours by an aggregate and a join, which
    Spark may split where a node has very many.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_staged(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
