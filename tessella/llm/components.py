"""Connected components of a link table, by rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import dropped, staged

HUBS = 500


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, as (u, v) with u > v."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_least(rows: DataFrame, total: int, also: str | None = None) -> DataFrame:
    """``rows`` (u, v) with m, the least v of each u (or ``also``, if that is less).

    A node of more than a HUBS-th of ``total`` links is a hub; ``rows`` are at most twice as many, so there are fewer
    than 2 * HUBS of them, and their minima are broadcast. No other node can fill a task.
    """
    lowest = F.least(F.min("v"), F.first(also)) if also else F.min("v")
    least = rows.groupBy("u").agg(lowest.alias("m"), F.count("*").alias("n"))
    hub = F.col("n") * HUBS > F.lit(total)
    hubs = F.broadcast(least.filter(hub).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(~hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied = _with_least(both, total, "u")
    return _ordered(tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    tied = _with_least(edges, total)
    # Each neighbour is tied to the least one, and so is the node itself.
    ends = F.explode(F.when(F.col("v") != F.col("m"), F.array("u", "v")).otherwise(F.array("u"))).alias("u")
    return _ordered(tied.select(ends, F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    The number of rounds grows with the logarithm of a component's length. Every round is a table in the shared
    folder; the one before it is deleted. Rows with a null end and loops link nothing.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    summed = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = staged(_ordered(edges), "links")
    mark = summed(now)
    while True:
        large = staged(_large_star(now, mark[0]), "links")
        dropped(spark, now)
        then = staged(_small_star(large, mark[0]), "links")
        dropped(spark, large)
        # Both steps keep components; when a round changes nothing, every node points at its component's least.
        now, before, mark = then, mark, summed(then)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
