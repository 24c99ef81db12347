"""Connected components of a large set of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.session import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    links: (u long, v long). Every round is written to the shared folder, so that a lost executor
    costs at most one round. A star's hot centre is only ever the key of a combinable minimum and of
    a join that adaptive execution can split.
    """
    star = scratch.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    path = scratch.last
    mark = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        star, old = scratch.keep(small), path
        path = scratch.last
        scratch.drop(old)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return star.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
