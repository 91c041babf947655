"""Connected components by alternating large-star and small-star rounds.

Each round joins the links to the smallest neighbour of each node; both steps
are aggregations with map-side combine and equi-joins, so a node with very many
neighbours is split by adaptive skew joins. Nothing is gathered on the driver
but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(links: DataFrame) -> DataFrame:
    """(src, dst) -> (node, component): the smallest node that each node reaches.

    Roots have no row: a node that is absent is its own component. Null ends
    and loops are ignored, repeated links count once, no links give no rows.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = durable(edges.where(u > v).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            return edges.select(u.alias("node"), v.alias("component"))
        before = state
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v > m).select(v.alias("u"), m.alias("v"))
        edges = durable(small.unionByName(least.select("u", m.alias("v"))).distinct())
