"""Connected components of a table of links, by alternating large and small stars.

Each round moves links to smaller neighbours until every node points at the smallest node of its component. A round
is two aggregations with partial sums and two joins that Spark can split where a node is hot; rounds are written
tables, so an executor's loss costs one round at most. Nothing but two numbers a round comes to the driver.

Defined results: links of a node to itself, and links with a null, join nothing; repeated links count once; nodes are numbers of any kind that has an order, and the smallest is the root; no links give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (columns u, v) that is not the smallest of its component."""
    links = save(links.select("u", "v").where("u != v").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = save(_small(_large(links)), "links")
        mark, old = _mark(links), mark
        if mark == old:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
