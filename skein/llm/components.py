"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    ``edges`` has columns a and b of any ordered type. Every step is a minimum per node (combined map-side) and a join
    of links with it, so a node with very many links never meets in one task; steps repeat until nothing changes, each
    one cut by a checkpoint in the shared folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .distinct().checkpoint())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
               .unionByName(least.select("u", F.col("m").alias("v")))
               .distinct().checkpoint())
