"""Connected components of an edge table, on the cluster.

Alternating large-star and small-star steps: each step groups the edges by one
end and points the other end at the group's least node; the edge set reaches
stars on the least node of each component.  Groups are reduced by ``min`` (a
partial aggregate in every task) and joined back, so a hub node does not meet
in one task; every step is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm.common import shared_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected ``edges`` (a > b)."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").withColumn("m", F.least("a", "m"))
    out = joined.where((F.col("b") > F.col("a")) if large else (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node;
    ``component`` is the least node reachable.  Null ends and loops are ignored."""
    edges = shared_table(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
        edges = shared_table(_star(_star(edges, True), False), "edges")
