"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join; the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._store import cut


#: Keys of more than HEAVY rows, and of more than one in MOST_HEAVY rows, are broadcast: fewer than MOST_HEAVY keys.
HEAVY, MOST_HEAVY = 1000, 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, parts: int | None = None) -> DataFrame:
    """rows joined with table, which has one row a key and in `weight` how many of rows have it. A key with a large share of
    the rows stays where its rows are, as its row of table is broadcast; the others are shuffled."""
    table = cut(table, parts)
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    limit = max(HEAVY, (total or 0) // MOST_HEAVY)
    if (most or 0) <= limit:
        return rows.join(table.drop(weight), key)
    heavy = F.broadcast(table.filter(F.col(weight) > limit).drop(weight))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.filter(F.col(weight) <= limit).drop(weight), key)
    return light.unionByName(rows.join(heavy, key))


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node that links reach.

    Large-star: every larger neighbour of u moves to u's least neighbour; small-star: u and its smaller
    neighbours move to the least of them. Neighbour lists are never gathered: minima are pre-aggregated,
    and those of nodes with many neighbours are broadcast to them. Ends when the links no longer change, which takes about
    the logarithm of the longest path's length in rounds, squared at most. What is written in between has at most `parts` partitions.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), parts)
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("w"))
        large = spread_join(both.filter("v > u"), least, "u", "w", parts).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))
        small = spread_join(large, low, "u", "w", parts).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = cut(small, parts)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
