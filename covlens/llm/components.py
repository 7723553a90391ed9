"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least_neighbour(near: DataFrame) -> DataFrame:
    """(a, m, star): the least of a and its neighbours, and whether a is a star's centre or hangs on one other id alone."""
    below, above = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
    star = (below == 0) | ((below == 1) & (above == 0))
    return near.groupBy("a").agg(F.min("b").alias("m"), star.alias("star")).select("a", F.least("a", "m").alias("m"), "star")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Every step joins the links with one row per id, so an id with very many
    links is split like any skewed join; a path of n links takes about log n
    rounds. Each round's links are written to the shared folder; links that are
    stars, every id linked with its component alone, need no further round.
    """
    links = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        near = _both_ways(links)
        least = stored(_least_neighbour(near), "least")
        if least.filter(~F.col("star")).isEmpty():
            break
        large = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large, "large-star")  # no more rows than links, some repeated; all b < a
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "small-star")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
