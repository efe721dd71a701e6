"""Running sums over the global order of a frame, without a window that one task would have to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._store import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int) -> DataFrame:
    """df with each column named in sums (new name: long column) added up over all rows in `order`, this row included.

    Rows are sorted by range into `parts` partitions and cut to a checkpoint; sums within partitions start from the sum of
    the partitions before, a table of one row a partition. Rows that are equal in `order` are in any order: end it with a
    column that tells them apart.
    """
    part = "__part"
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    starts = starts.select(part, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    summed = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(starts), part)
    return summed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(part, *[f"__{n}" for n in sums])
