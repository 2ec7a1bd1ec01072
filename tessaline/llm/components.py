"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Written, join_unequal


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    joined = join_unequal(both.filter("b > a"), least, ["a"], total)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_unequal(down, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Label each vertex of `links` (a, b: of one type that has an order) with the smallest vertex it reaches.

    Returns (vertex, component) for every vertex that has a link. No neighbour list is
    ever gathered: each round takes minima per vertex, which combine before the shuffle,
    and joins them back; the rows of a vertex with very many links stay spread, as its
    minimum is broadcast. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder. Links with a null end and links of a vertex to itself
    are ignored; an empty table gives none.
    """
    edges = Written(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        sign = edges.df.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min("a"), F.max("b")
        ).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        after = Written(_large_star(edges.df, 2 * sign[0]), "links")
        edges.drop()
        edges = Written(_small_star(after.df, sign[0]), "links")
        after.drop()
    stars = edges.df
    roots = stars.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionAll(roots)
