"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest neighbour of u, or u itself. Counted before it is joined, so a hub is no one task's work."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "m").alias("m"))


def _large(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select("v", "u"))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    return near.select("v", "m").union(near.select("u", "m")).toDF("u", "v").where("u <> v").distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (u, v: long); the root is the smallest node of its component.

    Each round writes its pairs to the shared folder; only their count and a sum of hashes reach the driver.
    The number of rounds grows with the logarithm of the longest chain.
    """
    now = stored(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = stored(_small(_large(now)), "links")
        after = _state(now)
        if after == state:
            break
        state = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
