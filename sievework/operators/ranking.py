"""Row numbers over a whole table without a single task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash


def global_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``, the place from 0 in the order of the columns ``order``.

    Ranges of the order become partitions, sorted in themselves; each row is written with its range and its place there,
    once, so that counts and places come from the same partitioning whatever is coalesced. The rows before a range, a sum
    over one row for each partition, shift its places. Ties come in any order, but each row has a place of its own.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stash(ranged.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranged")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    shifts = ranges.select("__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    # one row for each partition of the shuffle, so its size is bounded by the session's settings
    return ranged.join(F.broadcast(shifts), "__range").withColumn(name, F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")
