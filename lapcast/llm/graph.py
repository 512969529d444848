"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapcast.session import written


def _lowest(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down)
    return down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        lowest.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node on an edge; the component is its smallest node.

    Alternates large-star and small-star steps until the edges are stars: every step keeps the components and
    joins on nodes only. Each round is written to the shared folder, so no lineage grows and lost executors cost one round.
    """
    clean = lambda e: e.where("u <> v").distinct()
    stars = written(clean(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(stars)
    while seen[0]:
        stars = written(clean(_small_star(written(clean(_large_star(stars)), "edges"))), "edges")
        now = mark(stars)
        if now == seen:
            break
        seen = now
    spokes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return spokes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
