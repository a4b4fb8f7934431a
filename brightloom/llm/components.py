"""Connected components by alternating large-star and small-star, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import discard, small, stored


def _minima(least: DataFrame) -> DataFrame:
    """One row for each vertex, written first: broadcast if few, else the join with a hub's edges is one that Spark can split."""
    return small(stored(least, "minima"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex links to the least of the vertex and its neighbours."""
    both = edges.select("u", "w").union(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
    least = _minima(both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
    return both.where("w > u").join(least, F.col("u") == F.col("c")).select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, link to the least of them."""
    down = edges.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w"))
    least = _minima(down.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("c"), "m"))
    moved = down.join(least, F.col("u") == F.col("c")).where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("w"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Vertices that have links, with the least vertex of their component: (v, root).

    Rounds go on until the edges are stars around the least vertices, which the
    count and the sum of the edges' hashes show. Each round's edges are written to the
    shared scratch folder. No vertex's neighbours are ever gathered: minima are
    aggregated partially, and hubs only meet one row in the joins.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("w")).where("u <> w").distinct(), "edges")
    mark = None
    while True:
        wide = stored(_large_star(edges), "edges")
        discard(edges)
        edges = stored(_small_star(wide), "edges")
        discard(wide)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    roots = edges.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct()
    return edges.select(F.col("u").alias("v"), F.col("w").alias("root")).union(roots)
