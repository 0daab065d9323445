"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import materialise


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of every node on the least node of its neighbourhood.

    ``links`` has ``u > v``. Both ways is the large star, which moves the greater
    neighbours only; one way is the small star, which moves the lesser ones and the node.
    """
    if both_ways:
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = (
            links.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
    return moved.distinct()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``(node, root)`` of every node that has a link to another; root is the least node reached.

    Rounds grow with the logarithm of the longest chain. Every round is written to the
    shared folder, so no lineage builds up; only a count and a checksum reach the driver.
    Null ends and links of a node to itself are left out.
    """
    now = materialise(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where("u <> v")  # greatest and least skip a null, so such links fall out here too
        .distinct(),
        "links",
    )
    mark = None
    while True:
        now = materialise(_stars(_stars(now, True), False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
