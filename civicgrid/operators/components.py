"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgrid.sources.store import settled


def components(links: DataFrame) -> DataFrame:
    """id and root: the smallest id that each id of ``links`` (a, b) reaches; ids of any type with an order.

    Each round takes the smallest root among an id's neighbours, and then that root's own,
    so that the rounds grow with the logarithm of the longest path.
    """
    ways = settled(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    found = settled(ways.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("root")), "roots")
    while True:
        near = ways.join(found.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        least = settled(found.join(near, "id").select("id", F.least("root", "near").alias("to"), F.col("root").alias("was")), "least")
        onward = least.select(F.col("id").alias("to"), F.col("to").alias("onward"))
        moved = settled(least.join(onward, "to").select("id", F.col("onward").alias("root"), "was"), "roots")
        if moved.filter(F.col("root") != F.col("was")).isEmpty():
            return moved.select("id", "root")
        found = moved.select("id", "root")
