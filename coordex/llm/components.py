"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _crossed(edges: DataFrame) -> bool:
    """Whether some node of the edges (a, b) has two b, or is the a of one and the b of another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("from")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("from")))
    seen = ends.groupBy("node").agg(F.sum("from").alias("n"), F.min("from").alias("least"))
    return bool(seen.where((F.col("n") > 1) | (F.col("n") == 1) & (F.col("least") == 0)).limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the least node of its component, for every node
    of an edge. Large-star and small-star steps (each a partial aggregation and
    a join) until every component is one star; each round is a written table, and so
    are the least neighbours, so that a join can split the edges of a hub."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "component-edges")
    while _crossed(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "component-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = materialize(small.where("a <> b").distinct(), "component-edges")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
