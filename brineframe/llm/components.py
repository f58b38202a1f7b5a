"""Connected components of a table of links, by alternating large and small stars.

Each round is two groupings with map-side minima and joins; rounds are written to the shared
folder, so lineage stays short and a lost executor costs little. The number of rounds
grows with the square of the logarithm of the largest component; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from ..sources.tables import staged


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (hi, lo), hi > lo -> links to the smallest neighbour."""
    if large:
        near = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    else:
        near = links
    least = near.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m"))
    out = near.join(least, "hi")
    if large:  # neighbours above the node go to its minimum
        out = out.where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    else:  # the node and its lower neighbours go to the minimum
        out = out.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            least.select("hi", F.col("m").alias("lo")))
    return out.where(F.col("hi") > F.col("lo")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable; nodes without a link are absent."""
    spark = links.sparkSession
    links = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    links = staged(links, shared_dir(spark, "links"))
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        if not now[0]:
            break
        links = staged(_stars(_stars(links, True), False), shared_dir(spark, "links"))
    ends = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return ends.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
