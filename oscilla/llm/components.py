"""Connected components by alternating large and small stars, for links of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.session import durable

PARTS, PART_ROWS = 8, 10_000  # a table of links is written in so many parts, or more where a part would have more rows


def _written(links: DataFrame, at_most: int) -> DataFrame:
    """``links``, of at most so many rows, written in few files: rounds over few links are mostly the making of files."""
    return durable(links.coalesce(max(PARTS, -(-at_most // PART_ROWS))))


def components(links: DataFrame) -> DataFrame:
    """``node`` and the least ``root`` it is connected with, for every node of the links ``a``, ``b``.

    Each round writes the links to the shared folder.  It links the larger neighbours of a node to its
    least neighbour, then each node's smaller neighbours to the least of them, until nothing changes,
    which takes a number of rounds that grows with the logarithm of the longest chain.  Only a count
    and a checksum come to the driver.
    """
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = (
            both.join(least, F.col("hi") == F.col("n"))
            .filter(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        large = _written(large, 2 * n)
        small_least = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        moved = large.join(small_least, F.col("hi") == F.col("n")).filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = _written(moved.unionByName(small_least.select(F.col("n").alias("hi"), F.col("m").alias("lo"))).distinct(), 4 * n)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
