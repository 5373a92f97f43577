"""Connected components of a link table, as rounds of joins and minima.

Each round hangs the larger neighbours of every node on its least one, then every node on the least of the smaller ones (large and small
star).  The links become stars after a number of rounds that is logarithmic in the longest path; links that are stars already need none.
Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordworks.session import Scratch

LINKS_PER_FILE = 200_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(u, v) -> (node, root) with the least node of each component as its root, a table of `scratch`.  Nodes without a link to another
    aren't listed.  Each round's tables are dropped when the next is written."""
    edges = scratch.keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    files = max(1, edges.count() // LINKS_PER_FILE)  # rounds over few links have few tasks

    def kept(df: DataFrame) -> DataFrame:
        return scratch.keep(df.coalesce(files))

    def least(rows: DataFrame) -> DataFrame:
        """Least neighbour of each u, at most u itself.  Written, so that the join back can split a node with very many links."""
        return kept(rows.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")))

    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least_of_both = least(both)
        large = kept(both.join(least_of_both, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct())
        scratch.drop(edges, least_of_both)
        smaller = least(large)
        small = large.join(smaller, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = kept(small.unionByName(smaller.select("u", F.col("least").alias("v"))).filter("u <> v").distinct())
        scratch.drop(large, smaller)
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return scratch.step(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), edges)
