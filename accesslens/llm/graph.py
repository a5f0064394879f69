"""Connected components of a graph that only the cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, root`` of all nodes of ``edges`` (longs ``a, b``); the root is the smallest node reachable.

    Alternates large and small star operations, which keep the components and
    turn each into a star around its smallest node in a logarithmic number of
    rounds.  Each round is a minimum by node, combined before the shuffle, and a
    join with it whose sides are written tables, so that Spark can split a node
    with very many edges.  Nothing comes to the driver but two numbers a round.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    before = _fingerprint(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "graph-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "graph-large")
        small_least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "graph-least")
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct(), "graph")
        drop_staged(now, least, large, small_least)
        now, found = after, _fingerprint(after)
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components did not settle")
    # every component is a star now: its nodes point to the smallest one
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"] or 0
