"""Connected components of a graph by large-star and small-star steps (Kiveris and others, 2014), all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut

#: Nodes with more than this many edges, or than their share of all edges, are split.
LEAST_HOT, HOT = 256, 4096


def _with_least(edges: DataFrame, hot: int) -> DataFrame:
    """``edges`` (a, b) with ``low``, the least b of each a. A node with more than ``hot`` edges is dealt to several keys."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    # Few nodes can have so many edges: 2 * HOT rows at most for edges that are counted in both directions.
    split = F.broadcast(least.filter(F.col("n") > hot).select("a", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    own = edges.join(split, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    lows = least.drop("n").join(split, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return own.join(lows, ["a", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node that can be reached.

    Each round replaces the edges by fewer, shorter ones and is written to the shared folder, until none changes; the number
    of rounds grows with the logarithm of the graph's size. Both steps aggregate before they shuffle, and a node with very
    many edges is split. Self edges and repeated edges do no harm; an empty table gives an empty result.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = seen
        hot = max(LEAST_HOT, seen[0] // HOT)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, hot).filter("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct()
        small = _with_least(large, hot)
        now = cut(small.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), "edges")
