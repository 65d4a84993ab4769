"""Places of rows in one order over a whole table, without a single task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicgrid.sources.store import settled


def with_places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` from 1 on: ranges of the order are ranked by themselves, after the rows in earlier ranges.

    The order must tell all rows apart. Only a count for each range is put in order in one task.
    """
    names = [f"_o{k}" for k in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    ranged = settled(keyed.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), "ranges")  # read twice
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return ranged.withColumn("_in", inside).join(before, "_part").withColumn("place", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", *names)
