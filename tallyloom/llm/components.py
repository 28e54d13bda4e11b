"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, equal types): the smallest node it can reach.

    Alternating star steps: each node hands its larger neighbours, then its smaller ones, to the
    smallest. Degrees are handled by aggregates and joins, never by lists, so a node with very
    many neighbours is split like any skewed key. Each round is written to the shared folder;
    the number of rounds grows with the logarithm of the longest path.
    """
    here = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    here = frozen(here, label)
    before = None
    while True:
        pairs = _both_ways(here)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node that is itself the smallest of its neighbourhood keeps its edges through the line above.
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        joined = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        here = frozen(joined.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), label)
        now = here.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = here.select("b").distinct()
    return here.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
