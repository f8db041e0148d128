"""Connected components of a large set of links by alternating large-star and small-star steps.

Every round is a grouped minimum and a join for each of the two steps, and is written to the shared folder; no link or label
reaches the driver but for a row count and a checksum. A node that holds over a thousandth of all links, such as the root of
a large component, is joined by a broadcast of at most a thousand such nodes, so no task gets all its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, write_table

#: Links that any task can hold; below that, no node is looked at for its number of links.
FEW = 100_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, large: bool, hubs: DataFrame | None) -> DataFrame:
    both = _both(links)
    if not large:
        both = both.filter(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    rows = both.filter(F.col("v") > F.col("u")) if large else both
    if hubs is None:
        met = rows.join(least, "u")
    else:
        few = F.broadcast(hubs)
        met = rows.join(F.broadcast(least.join(few, "u", "left_semi")), "u").unionByName(rows.join(few, "u", "left_anti").join(least, "u"))
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches. links has the columns u and v (no nulls).

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path. An empty set of links
    gives an empty result; repeated links and self links change nothing.
    """
    spark = links.sparkSession
    first = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    path, before = write_table(first, "links"), None
    while True:
        now = spark.read.schema(first.schema).parquet(path)
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == before:
            break
        before = n, mark
        hubs = None
        if n > FEW:
            hubs = _both(now).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * n / 1000).select("u")
        last, path = path, write_table(_star(_star(now, True, hubs), False, hubs), "links")
        discard(spark, last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
