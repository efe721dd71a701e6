"""Joins of series: as-of by one sort, rows of both sides in one order of time, the nearest match carried along; and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
SIDE, AT, MATCH = "__side", "__at", "__match"


def attach(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left with what right has for the same `on`; NULL has no match. Compared null-safely, as a plain left join would filter
    NULLs out of all that right is made of: bars made of filtered trades can't be read from the shuffle that left reads."""
    return left.join(right.withColumnRenamed(on, "__on"), C(on).isNotNull() & C(on).eqNullSafe(C("__on")), "left").drop("__on")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], direction: str = "backward", tolerance: Column | None = None) -> DataFrame:
    """left with `columns` of the nearest right row of the same `by`: the last one at or before left_time (backward), or the
    first one at or after it (forward); NULL where there is none, where left_time is NULL, or where it is
    further away than `tolerance` (an interval, or days for dates). Of right rows of one time the one with the largest columns is taken (backward), or the smallest.

    Time grows with the rows of both sides, however many left rows a key has.
    """
    back = direction == "backward"
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    kept = F.struct(*[C(c) for c in left.columns])
    found = F.struct(C(right_time).alias(AT), *[C(c).alias(f"_{k}") for k, c in enumerate(columns)])
    none = lambda df: F.lit(None).cast(df.select(found.alias("x")).schema["x"].dataType)
    # on a tie the right row stands on the side that the left row looks to
    l_rows = left.select(*by, C(left_time).alias(AT), F.lit(1 if back else 0).alias(SIDE), kept.alias("__left"), none(right).alias(MATCH))
    r_rows = right.filter(C(right_time).isNotNull()).select(*by, C(right_time).alias(AT), F.lit(0 if back else 1).alias(SIDE), F.lit(None).cast(l_rows.schema["__left"].dataType).alias("__left"), found.alias(MATCH))
    order = Window.partitionBy(*by).orderBy(AT, SIDE, MATCH)
    near = F.last(MATCH, True).over(order.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first(MATCH, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = l_rows.unionByName(r_rows).withColumn("__near", near).filter(C("__left").isNotNull())
    ok = C(AT).isNotNull()
    if tolerance is not None:
        ok &= (C(f"__near.{AT}") + tolerance >= C(AT)) if back else (C(AT) + tolerance >= C(f"__near.{AT}"))
    return out.select("__left.*", *[F.when(ok, C(f"__near._{k}")).alias(c) for k, c in enumerate(columns)])
