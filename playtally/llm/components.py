"""Connected components of links, in rounds of joins; no component meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of `links` (a, b).

    Each round every node hands its larger neighbours the smallest node it sees, then each node joins its
    smaller neighbours to the smallest (large star, small star). Links become stars after some
    logarithm of the longest path. A node's neighbours are only aggregated, so hubs do no harm.
    """
    links, before = stored(_directed(links)), None
    while (now := _print(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = _directed(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = stored(large)
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("low")), "a")
        links = stored(
            _directed(
                joined.select("a", F.col("low").alias("b")).unionByName(
                    joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
                )
            )
        )
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return members.unionByName(roots).distinct()


def _print(links: DataFrame) -> tuple:
    """Number and combined hash of the links; a round that changes nothing leaves both."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _directed(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node, without loops."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
